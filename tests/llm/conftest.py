import pytest


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names operators use themselves."""

    def docs(rows, **columns):
        extra = {"fp": "string", "size": "string", "bin": "string", "tag": "string", "anchor": "string", "n_words": "string", "place": "string", "kept": "string", "length": "string", "block": "string", "target": "string", "a.b": "string", "whole": "string", "w": "string", "l": "string", "node": "string", "h": "string", "root": "string", "tag.x`y": "string"}
        filled = [(i, t, "en", "s", *["x"] * len(extra)) for i, t in rows]
        names = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c.replace('`', '``')}` {k}" for c, k in extra.items())
        return spark.createDataFrame(filled, names)

    return docs
