import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark):
    """(doc_id, text) of the smallest documents table."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that tend to break things: nothing, blanks, control characters, other scripts, one very long one."""
    return [None, "", " ", "\n\n", "a", "a b", "\x00\x1c\x1f", " x y", "Straße ÉTÉ ΣΑΣ İ ǅ", "日本語 のテキスト",
            "é ẛ̣ ﬁ", "👩‍👩‍👧 🏳️‍🌈", "tab\tand\x0bfeed\x0c.", "<|endoftext|><|startoftext|>", "▁▁ under ▁",
            "x" * 5000, ("lorem ipsum dolor " * 4000).strip(), " " * 40 + "q", "password = hunter2hunter2"]
