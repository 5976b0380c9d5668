"""Dataflows of the engine; every public function takes and returns DataFrames."""
