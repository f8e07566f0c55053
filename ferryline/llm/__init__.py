"""Operators of a training-data pipeline.

Nothing else in the library imports this package. Conventions shared by all operators:

* input is a DataFrame with at least ``doc_id`` (integer) and ``text`` (string); other columns are
  ignored, whatever their names, and a null text counts as empty;
* working columns are made by ``select``, so they cannot clash with columns of the input;
* large intermediate results go to the folder in ``spark.checkpoint.dir`` (see ``_shared``), never to
  a machine-local folder and never to an executor's cache, so a lost executor costs a re-read only.
"""
