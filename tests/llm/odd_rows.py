"""Texts that operators must bear: null, empty, white space only, very long, repeated; Ellipsis stands for a row of nulls."""

LONG = "word " * 30_000 + "end"
ODD = [None, "", " \n\t ", "a", "Ein Wort\n\nzwei", "é\U0001F600 中", LONG, Ellipsis, "same text here for you all", "same text here for you all"]
