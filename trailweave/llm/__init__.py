"""Operators a training-data pipeline needs.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.

Conventions common to all operators:

* Only the named input columns are read.  Further columns, also such as have the
  name of an output column, are ignored and never reach the result.
* A null text counts as the empty text, and a null id stays null in the result.
* Repeated rows are kept: each input row gives its own output row or rows.
* An empty table gives an empty result with the same schema.
"""
