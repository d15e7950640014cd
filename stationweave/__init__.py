"""Station-observation analytics on Spark DataFrames.

Every public function takes DataFrames (or a session and paths) and returns a
lazy DataFrame; nothing here opens a session of its own.
"""

__version__ = "0.1.0"
