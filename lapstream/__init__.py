"""Race-timing analytics as Spark jobs.

Feeds in, state and laps out: every public function takes DataFrames and gives a
DataFrame, so the same code runs over a recorded batch or inside a stream.
"""
