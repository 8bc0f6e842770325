"""Operators for training-data pipelines: dedup, mixing, search, scans, token files, scoring, packing.

Nothing else in the library imports this subpackage. Shared conventions:

* Every operator selects the columns it names and ignores all others, so
  extra or clashing columns never reach its plan.
* Words are maximal runs of non-separator bytes; the separators are given by
  each operator's contract. A null text is the empty text.
* Intermediate tables go to the shared folder of ``spark.checkpoint.dir``.
"""
