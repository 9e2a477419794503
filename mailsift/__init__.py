"""mailsift: set-oriented message triage on Spark DataFrames.

Every operator takes and returns ``Column`` or ``DataFrame`` values so that
Catalyst sees one declarative plan per job.
"""

__version__ = "0.1.0"
