"""Rows for the edge tests."""

# nulls, blanks, repeated rows, ties, long texts, odd characters
EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "a"), (5, "same words in a row " * 3), (5, "same words in a row " * 3),
        (6, "same words in a row " * 3), (None, "no id here at all"), (None, None), (7, "x " * 5000),
        (8, "é ü İ ſ K   　 日本 語"), (9, "A\x0bB\x0cC\rD\n\nE"), (10, "word " * 9), (11, "!!! ??? | ### $$$")]
