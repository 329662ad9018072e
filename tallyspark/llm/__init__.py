"""Training-data operators over `documents`, `pages` and `conversations`.

Nothing outside this subpackage imports it.  Each module holds one operator with its general interface and the thin
query that the driver registers; `registry` lists the queries and the SQL that checks them.
"""
