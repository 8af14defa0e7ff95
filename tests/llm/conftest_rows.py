"""Rows that the tests of several operators use."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i * i % 1009}" for i in range(30_000))
LINE = "A line that is long enough to count"


def rows():
    """Nulls in each column, empty, blank and very long texts, ties and repeated rows, near copies."""
    base = " ".join(f"alpha{i}" for i in range(60))
    return [
        (1, f"{LINE}\nown one\n{base}", "en", "web", 10),
        (2, f" {LINE.upper()}\t\nown two\n\nown two", "en", "web", 10),
        (2, f" {LINE.upper()}\t\nown two\n\nown two", "en", "web", 10),
        (3, None, None, None, None),
        (4, "", "de", "books", 0),
        (5, " \t\n\r\x0b\x0c", "de", "books", 6),
        (6, LONG, "fr", None, len(LONG)),
        (7, LONG, "fr", "", len(LONG)),
        (8, base + " tail", None, "web", 1),
        (9, base, "en", "web", 1),
        (10, base, "en", "books", 1),
        (11, "wide éÉあ\U0001f600 words here\n" + LINE, "en", "web", 2),
        (None, base, "en", "web", 2),
        (None, None, None, None, None),
        (12, "short", "en", "web", 5),
    ]
