"""Rows that every operator has to survive, and brute-force versions of the operators."""

from __future__ import annotations

import re

WORD = re.compile("[^\x20\x09-\x0d]+")
BLANK = " \t\n\r\x0b\x0c"

LINE = "This very line is long enough to count and is found in many documents."


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


#: (doc_id, text, lang): nulls, empty and blank texts, ties, repeated rows, odd characters, a very long text
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away into the dark green woods.", "en"),
    (2, "The quick brown fox jumps over the lazy dog and runs away into the dark green woods.", "en"),
    (2, "The quick brown fox jumps over the lazy dog and runs away into the dark green woods.", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, " \t\n\x0b\x0c\r ", "fr"),
    (None, "A row without an id, but with a text of more than ten words in it.", "en"),
    (None, None, None),
    (6, "1234 5678 !!! ??? ...", "de"),
    (7, "a b c d e a b c d e a b c d e a b c d e", "en"),
    (8, "é ß ñ 汉字 \U0001f600 x́ \x85 　 <|endoftext|> ²½ Ⅷ it's  two  blanks \n\n end", "fr"),
    (9, "word " * 30_000, "en"),
    (10, "x" * 50_000, "de"),
    (11, f"{LINE}\nfirst", "en"),
    (12, f"  {LINE.upper()}\t\nsecond\n{LINE}", "en"),
    (13, f"third\n{LINE}", "en"),
    (14, f"{LINE}\r\nfourth", "en"),
    (15, f"fifth\n\n{LINE}\n", "en"),
    (16, "### $$$ %%% &&& ||| <<< >>> *** ### $$$ %%% &&& ok", "en"),
    (17, "Le renard brun saute par-dessus le chien paresseux et court dans la forêt sombre.", "fr"),
    (18, "Der schnelle braune Fuchs springt über den faulen Hund und läuft in den dunklen Wald.", "de"),
]
SCHEMA = "doc_id long, text string, lang string"
