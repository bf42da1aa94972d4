"""Rows that every operator must take."""

#: Null and empty texts, ties, repeated rows, white space, one long text.
ODD = [
    (1, None),
    (2, ""),
    (3, "one line of text that is long enough to count"),
    (4, "one line of text that is long enough to count"),
    (5, "One line of text that is long enough to COUNT  \nand another line here"),
    (6, "One line of text that is long enough to COUNT  \nand another line here"),
    (6, "One line of text that is long enough to COUNT  \nand another line here"),
    (None, "one line of text that is long enough to count\n\n"),
    (7, "\n\n\n"),
    (8, "wörter mit ümlaut und ß, 漢字 かな 12,5 kg 😀 "),
    (9, "word " * 30_000),
    (10, " \t\x0b\x0c\r "),
]
