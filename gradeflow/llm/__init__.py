"""Training-corpus operators: quality, licences, near and exact copies, secrets, URLs, rules, tokens, language models, packing.

Nothing outside this subpackage imports it; its queries are in ``queries.py``.
"""
