"""Labelled findings for the secret scan where no table of them is given.

A seeded set of planted credentials and of look-alikes (digests, ids, paths, placeholders, long words), between words
that the caller counts from its own corpus. It stands in for reviewed findings; a table of these is better.
"""

from __future__ import annotations

import numpy as np

# Words that announce a credential.
ANNOUNCE = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth", "credential", "private", "bearer"]


def example_findings(words: list[str], n: int = 6_000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (before, value, after, path, label), planted by rule between ``words``."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    draw = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    hexes, lower = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    mixed = lower + lower.upper() + "0123456789"
    prose = lambda k: " ".join(pick(words) for _ in range(k))
    paths = ["", "src0", "app/settings.py", "deploy/config.yml", ".env", "lib/auth.js", "tests/test_login.py", "docs/readme.md", "package-lock.json", "vendor/x.sum"]
    # What people choose: a word with some digits, and a phrase of words with a few odd ones.
    short = lambda: pick([str.lower, str.title])(pick(words))[:14] + draw("0123456789", int(rng.integers(1, 5))) + pick(["", "", "!", "#"])
    phrase = lambda: " ".join([*(pick(words) for _ in range(int(rng.integers(2, 4)))), draw("0123456789", 1) + pick(words), *(pick(words) for _ in range(int(rng.integers(1, 3)))), draw(mixed, int(rng.integers(3, 9)))])
    out = []
    for i in range(n):
        before, after, path = prose(4), prose(4), pick(paths)
        if i % 2:
            value = pick([lambda: draw(hexes, 40), lambda: draw(hexes, 32), lambda: "AKIA" + draw(mixed.upper(), 16), lambda: "ghp_" + draw(mixed, 36), lambda: draw(mixed + "!@#%", int(rng.integers(10, 24))), lambda: draw(mixed + "+/", 40), lambda: "xoxb-" + draw("0123456789", 12) + "-" + draw(mixed, 24), short, phrase])()
            sign = pick([' = "', ": '", '="']) if " " in value else pick([' = "', " = ", "=", ": ", ": '"])
            word = pick(ANNOUNCE)
            if value[:4] in ("AKIA", "ghp_", "xoxb") and rng.random() < 0.3:
                word, sign = prose(1), " "
            out.append((f"{before} {pick([word, word.upper(), 'my_' + word])}{sign}", value, pick(['" ', "' ", "\n", " "]) + after, path, 1))
        else:
            case = int(rng.integers(9))
            if case == 0:
                out.append((f"{before} {pick(['commit', 'sha1', 'md5', 'checksum', 'etag', 'revision'])}{pick([' ', ': ', '='])}", draw(hexes, int(pick([32, 40, 64]))), " " + after, path, 0))
            elif case == 1:
                v = draw(hexes, 32)
                out.append((f"{before} {pick(['id', 'uuid', 'request'])} ", "-".join([v[:8], v[8:12], v[12:16], v[16:20], v[20:]]), " " + after, path, 0))
            elif case == 2:
                out.append((f"{before} {pick(ANNOUNCE)}{pick([' = ', ': '])}", pick(["changeme123", "your-password-here", "example_token_value", "xxxxxxxxxxxxxxxx", "<your-secret>", "${SECRET_NAME}", "placeholder-value-1", "default_password"]), " " + after, path, 0))
            elif case == 3:
                out.append((before + " ", "/".join(prose(1) for _ in range(4)) + f"/{pick(['index', 'main', 'page'])}{int(rng.integers(100))}.html", " " + after, path, 0))
            elif case == 4:
                out.append((before + " ", draw("0123456789", int(rng.integers(16, 24))), " " + after, path, 0))
            elif case == 5:
                out.append((before + " ", "".join(pick(words) for _ in range(4)) + str(int(rng.integers(10))), " " + after, path, 0))
            elif case == 7:
                out.append((f"{before} {pick(ANNOUNCE)}{pick([': ', ' = ', '='])}" + '"', pick([prose(int(rng.integers(3, 7))), "please enter your password here", "must not be empty"]), '" ' + after, path, 0))
            elif case == 6:
                out.append((f"{before} {pick(ANNOUNCE)}: ", prose(1) + prose(1) + "ing", " " + after, path, 0))
            else:
                out.append((before + " ", f"{prose(1)}.{int(rng.integers(100))}@{pick(['mail', 'web'])}{int(rng.integers(9))}.example.com".replace("@", "-at-"), " " + after, path, 0))
    return out
