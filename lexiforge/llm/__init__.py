"""Operators for preparing language-model training data at scale.

Nothing outside this package imports it, except the guarded registration in
``__spark_entry__`` and ``corpus_pipeline``.

Shared conventions of every operator:

* identifiers and texts are picked by column name, so further columns of the
  input, whatever their names, cannot clash with internal ones;
* a null text is the empty text;
* a null identifier is an identifier of its own that sorts before all others;
* equal rows are separate rows: each gets its own output row;
* an empty input gives an empty output with the full schema.
"""
