"""Training-data operators.  Nothing outside this folder imports it; each module states its
contract in its docstring and ``queries.py`` holds the registered queries and their SQL."""
