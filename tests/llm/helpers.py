"""Rows that every operator must survive, and the folder of the small tables."""

SF = "/root/testdata/sf0.001"


def words(n, word="w"):
    return " ".join(f"{word}{i}" for i in range(n))


ODD = [
    (1, "", "en", "a", 0), (2, None, "en", "a", None), (3, "   \t\n", None, None, 3), (4, words(30_000), "en", "a", None), (5, "x" * 300_000, "de", "b", None),
    (None, "a text without an id", "en", "b", 20), (None, None, None, None, None), (7, "The same row twice. " * 20, "en", "a", 1), (7, "The same row twice. " * 20, "en", "a", 1),
    (8, "Ärger über größere Straßen 日本語 😀 ½ ²", "de", "c", 1), (9, "12345 ### !!", "fr", "c", 1), (10, "The same row twice. " * 20, "en", "", 1),
]
