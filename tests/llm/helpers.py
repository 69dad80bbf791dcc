"""Small inputs with the cases that every operator must take."""

from __future__ import annotations

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
TEXTS = [
    None, "", "   \n\t ", "one", "to be or not to be", "Mixed CASE words, here! and more of them",
    "same text again and again in this row", "same text again and again in this row", "line\nline\n\nline\n x\ty  z ",
    "é ß ñ 日本語 🙂 ▁ ␛0 end", "a" * 5000, LONG,
]


def documents(spark, texts=TEXTS, more: bool = True):
    """documents with a null doc_id, a repeated row, and columns whose names clash with results."""
    rows = [(i if i != 5 else None, t, "en", f"s{i % 3}" if i % 4 else None, len(t) if t else 0) for i, t in enumerate(texts)]
    rows += rows[4:5] if len(rows) > 4 else []
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if more:
        for name in ("kept", "fp", "ids", "block", "score", "spans", "node", "shard", "class"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df
