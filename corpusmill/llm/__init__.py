"""Operators for building training data from large document collections.

Nothing outside this subpackage imports it. Conventions shared by all of them:

* Documents are identified by ``doc_id``. Rows that repeat both ``doc_id`` and ``text`` are one
  document read twice: it is judged once and each of its rows gets the same result.
* A null text has no words and no lines; it never fails.
* Only the columns that an operator names are read, so extra columns cannot clash.
"""
