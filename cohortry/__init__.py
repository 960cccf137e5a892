"""Segmentation and auto-labelling on Spark DataFrames.

Raw event tables or document collections go in; explained, validated segments
come out.  Every operator is a function ``DataFrame(s) + parameters ->
DataFrame`` (or a small driver-side dataclass when the result is a decision).
"""

__version__ = "0.1.0"
