"""Inputs that every operator has to take."""

SF = "/root/testdata/sf0.001"

#: Nulls, empty and blank texts, repeated rows, ties, and texts without letters.
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (5, "a"), (None, None), (None, "one two three four five"),
         (6, "12345 !!! ..."), (7, "é ü 😀 ß"), (8, "x" * 20_000), (9, "word " * 6_000)]
