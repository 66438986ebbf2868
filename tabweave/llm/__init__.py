"""Operators for preparing training text: every one takes and returns DataFrames.

Conventions shared by all of them: a null text counts as the empty text, extra
columns are carried or ignored but never clash (working columns start with
``_tw_``), repeated rows are treated one by one, and an empty table gives an
empty result of the same schema.
"""
