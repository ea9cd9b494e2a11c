"""Random values after an equals sign, as in env files, query strings and connection strings."""

import pytest

from weftline.llm import secrets

KEY = "wJalrXUtnFEMIK7MDENGbPxRfiCYzQ4vT9aLs2"


@pytest.mark.parametrize(
    "text, found",
    [
        (f"AUTH={KEY}\nHOME=/root", KEY),
        (f"https://a.example/x?sig={KEY}==&x=1", KEY + "=="),
        (f"?x=1&sig={KEY}&y=2", KEY),
        (f"Endpoint=sb://a;AccountKey={KEY}=;Pool=5", KEY + "="),
        (f"{KEY}=yes", KEY),
        (f"key: {KEY}", KEY),
        ("NAME=internationalisation2024 MODE=snake_case_name_of_version_10", None),
        ("x=" + "=" * 40, None),
    ],
)
def test_values_after_an_equals_sign(text, found):
    want = [(text.index(KEY), text.index(KEY) + len(found))] if found else []
    assert secrets.random_runs(text) == want
    base, spans = secrets.spans_of(text)
    assert base == [] and [s[:2] for s in spans] == want
    assert KEY not in secrets.redacted(text, spans)


def test_scan_and_redaction(spark):
    df = spark.createDataFrame([(1, f"AUTH={KEY}\nnext")], "doc_id long, text string")
    row = secrets.scanned(df).first()
    assert row["n_random"] == 1 and row["spans"] == f"random:5:{5 + len(KEY)}"
    assert secrets.without_secrets(df).first()["text"] == "AUTH=[random removed]\nnext"
