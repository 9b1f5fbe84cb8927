import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHING = ["score", "kept", "label", "words", "rank", "set_id", "key", "canonical", "count", "length", "node", "root", "said", "__kept_id"]


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.3 else "".join(rng.choice(["an", "the", "ri", "on", "sel", "mo", "ta"]) for _ in range(3)) for _ in range(n)) + "."


def odd_documents():
    rng = random.Random(11)
    rows = []
    for i in range(60):
        text = prose(rng, rng.randint(20, 120))
        if i % 10 == 3:
            text = " ".join(w + "###" for w in text.split())
        if i % 10 == 7:
            text = text.replace(" of ", " idiot ") + " you stupid idiot moron."
        rows.append((i, text, "en" if i % 3 else "de", f"src{i % 4}", len(text)))
    item = prose(random.Random(99), 30)
    rows += [
        (100, None, None, None, None),
        (101, "", "en", None, 0),
        (102, " \t\n ", "en", "s", 4),
        (103, "1234 5678", "en", "s", 9),
        (None, rows[4][1], "en", "s", 5),
        (104, rows[5][1], "en", "s", 5),
        (5, rows[5][1], "en", "s", 5),
        (105, prose(rng, 60_000), "en", "s", 5),
        (106, prose(rng, 40) + "\n" + item + "\n" + prose(rng, 40), "en", "s", 5),
        (107, "x" * 20_000, "en", "s", 5),
        (108, "Licensed under the MIT License. " * 3, "en", "s", 5),
    ]
    labels = [(i, 0 if i % 10 == 3 else 1, int(i % 10 == 7)) for i in range(60)] + [(None, 1, 0), (1, None, None), (900, 1, 1)]
    return rows, labels, [(1, item), (2, None), (3, ""), (3, item), (None, "one two")]


def odd_pages():
    page = "<html><head><title>t</title><script>a='<p>'</script></head><body><nav><a href='/'>Home</a></nav><div class=\"ad\">Buy now</div><article><h1>{0}</h1><p>{1} &amp; more<br>again</p><p>{2}</p></article><footer>&copy; me</footer>"
    rng = random.Random(3)
    rows = [(i, f"https://www.host{i % 5}.example.net/en/{i}?utm_source=x#top", page.format(prose(rng, 4), prose(rng, 30), prose(rng, 50))) for i in range(40)]
    return rows + [(50, None, None), (51, "no scheme", ""), (52, "http://m.casino-win.example.org/a.html", "<p>unclosed <b>text"), (52, "http://m.casino-win.example.org/a.html", "<"), (None, "http://EXAMPLE.com/de/x", "plain")]


def odd_embeddings():
    """Copies, near copies, ties, repeated rows and ids, and vectors that link with nothing."""
    rng = random.Random(5)
    rows = []
    for i in range(1, 90):
        v = [rng.gauss(0, 1) for _ in range(8)]
        rows.append((i, v, i % 3))
    first = rows[0][1]
    rows += [(100 + i, [x + rng.gauss(0, 0.05) for x in first], 1) for i in range(30)]
    rows += [(200 + i, list(first), 1) for i in range(40)] + [(300, list(first), 1)] * 2 + [(300, list(first), 2), (None, list(first), 1)]
    nan, inf = float("nan"), float("inf")
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 8, 1), (403, [nan] * 8, 1), (404, [inf] + [0.0] * 7, 1), (405, [None] + [1.0] * 7, 1), (406, list(first), None), (407, [2 * x for x in first], 1), (408, [1.0, 2.0], 1)]
    return rows


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    """Tables with nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    out = str(tmp_path_factory.mktemp("odd"))
    rows, labels, items = odd_documents()
    extra = {c: F.lit("x") for c in CLASHING}
    spark.createDataFrame(rows, DOCS).withColumns(extra).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1)).write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame(odd_pages(), "page_id long, url string, html string").withColumns(extra).write.parquet(f"{out}/pages.parquet")
    clashing = {**extra, **{c: F.lit("x") for c in ("place", "unit", "q", "cell", "copies", "anchor", "block", "first")}}
    vectors = spark.createDataFrame(odd_embeddings(), "vec_id long, embedding array<double>, of int").withColumns({k: v for k, v in clashing.items() if k != "label"})
    vectors.withColumnRenamed("of", "label").write.parquet(f"{out}/embeddings.parquet")
    return out


@pytest.fixture(scope="session")
def empty_dir(spark, odd_dir, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{odd_dir}/{name}.parquet").limit(0).write.parquet(f"{out}/{name}.parquet")
    return out
