"""Small documents with every awkward case: nulls, empty and long texts, ties, repeats, clashing columns."""

DOCS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, rid int, spans int, w int, h int, n int, `a.b` int"


def docs(texts, ids=None):
    ids = ids or range(len(texts))
    return [(i, t, None, "src", None if t is None else len(t), "x", 1, 2, 3, 4, 5, 6) for i, t in zip(ids, texts, strict=True)]
