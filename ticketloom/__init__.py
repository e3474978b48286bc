"""Support-ticket triage on Spark DataFrames.

Every public function takes and returns DataFrames or Columns; none keeps a session.
"""
