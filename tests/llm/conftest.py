import pytest

#: Names that the operators use inside, as columns of their input.
CLASHING = "id body key token n label score size segment held group part kind payload row words terms p0 own refers_to".split()


@pytest.fixture
def make(spark):
    """Documents from texts or (doc_id, text) pairs, with further columns whose names clash."""

    def build(texts, name="text", key="doc_id"):
        rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
        schema = f"{key} bigint, {name} string, " + ", ".join(f"`{c}` string" for c in CLASHING if c not in (name, key))
        return spark.createDataFrame([(*r, *["x"] * (schema.count(",") - 1)) for r in rows], schema)

    return build


@pytest.fixture
def odd_texts():
    """Null, empty and blank texts, odd spaces, marks, ties, and a long text."""
    return [
        None, "", " ", "\n\t \n", "a", "a b", "a b c", "a b c", "A B C", "  two  leading and  double   spaces ", "tab\tand\nline\r\nends\x0b\x0c", "▁marked ▁ text▁", "<s> </s> <unk> <|endoftext|> x", "ﬁ Å é é 日本語 😀  nbsp em", "x\x00y \x1c z",
        "word " * 3000, "".join(f"w{k} " for k in range(5000)), "!!! ### $$$ 12 3.4", "the quick brown fox jumps over the lazy dog " * 6, "Don't we'll I'M it's", "q" * 3000,
    ]
