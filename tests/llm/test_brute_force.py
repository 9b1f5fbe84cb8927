"""Operators against plain-Python definitions on small tables."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from check_queries import compare, connect
from subdiv.llm import crf, decontaminate, html_extract, language_id, license_scan, ngram_join, packing, quality_rules, toxicity, url_filter
from subdiv.llm import text as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(spark, folder):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def test_words_and_hashes():
    texts = ["Hello  wörld hello", "", None, "a b c a b c", " x ", "éa", "tab\there\x0bz"]
    got = []
    for block in X.blocks(pa.array(texts), limit=9):
        words = block.words(X.NOT_SPACE)
        got += [[bytes(block.data[s:e]).decode() for s, e in zip(words.start[a:b], words.end[a:b])] for a, b in zip(words.bounds, words.bounds[1:])]
    assert got == [WORD.findall(t or "") for t in texts]
    (block,) = X.blocks(pa.array(["Ab cd ab", "AB"]))
    h = block.words(X.NOT_SPACE).hashes(X.byte_values(True))
    assert h[0] == h[2] == h[3] != h[1]


def test_url_filter(spark, odd_dir):
    assert compare(url_filter.op1_url_filter(spark, odd_dir), connect_folders(odd_dir), url_filter.OP1_SQL) is None


def connect_folders(folder):
    con = connect("/nonexistent")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    return con


def jaccard_components(rows, n, percent):
    sets = {}
    for i, text in rows:
        w = WORD.findall(text.translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_ngram_join(spark, n, percent):
    rng = random.Random(n)
    rows, i = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 2, 4, 9, 30, 80, 200]))]
        for _ in range(rng.choice([1, 2, 12])):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 12)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(60)}"
            rows.append((i, " ".join(words)))
            i += 1
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()}
    assert got == jaccard_components(rows, n, percent)

def test_large_regions_are_divided_instead_of_paired(spark, monkeypatch):
    """Near copies whose common text is missing: no pair of them links, but nearly all bitmaps allow it."""
    base = [f"w{i}" for i in range(419)]
    rows = [(i, " ".join(base[: 11 * i] + [f"c{i}x{j}" for j in range(9)] + base[11 * i + 9 :])) for i in range(38)]
    rows += [(100 + i, rows[i][1] + " tail") for i in range(3)]
    made = []

    def counted(df, name, *more, real=ngram_join.materialize):
        out = real(df, name, *more)
        made.append(out.count() if "pairs" in name else 0)
        return out

    monkeypatch.setattr(ngram_join, "REGION", 4, raising=False)
    monkeypatch.setattr(ngram_join, "materialize", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == jaccard_components(rows, 3, 90)
    assert sum(made) <= len(rows)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (2, 60)])
def test_divided_regions_lose_no_link(spark, monkeypatch, n, percent):
    monkeypatch.setattr(ngram_join, "REGION", 2)
    test_ngram_join(spark, n, percent)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = a.copy()
        b[rng.random(len(b)) < rng.random() * 0.15] += np.uint64(1)
        b = np.unique(b[: max(1, len(b) - int(rng.integers(0, 3)))])
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both):
            kept = []
            for x in (a, b):  # under any common order, here by value
                sigs, notes = ngram_join.signatures(x, percent)
                kept.append(np.concatenate([np.sort(sigs[notes == m])[: (notes == m).sum() - m % 65536] for m in np.unique(notes)]))
            assert np.intersect1d(*kept).size


def edits(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edit_distances():
    rng = random.Random(2)
    items = [[rng.randrange(4) for _ in range(rng.randint(1, 9))] for _ in range(60)]
    regions = [[rng.randrange(4) for _ in range(rng.randint(1, 14))] for _ in range(60)]
    got, _ = decontaminate.edit_distances([np.array(x) for x in items], [np.array(x) for x in regions])
    assert got.tolist() == [edits(a, b) for a, b in zip(items, regions)]


def test_decontamination_recall_and_precision(spark):
    rng = random.Random(5)
    items = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.randint(14, 60)))) for i in range(30)]
    rows, truth = [], set()
    for i in range(300):
        filler = [" ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.randrange(50))) for _ in range(2)]
        words = []
        if i % 3:
            item, text = items[rng.randrange(30)]
            words = text.split()
            for _ in range(rng.randint(0, int(0.2 * len(words)))):
                words[rng.randrange(len(words))] = "zzzz"
            truth.add((i, item))
        rows.append((i, " ".join([filler[0], *words, filler[1]])))
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert len(got & truth) >= 0.95 * len(truth) and got <= truth


def test_best_fit_packing_round_trip(spark, odd_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = texts_of(spark, odd_dir)
    got = packing.op8_best_fit_packing(spark, odd_dir).collect()
    expect = collections.Counter()
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        start, k = 0, 0
        while start < len(ids):
            n = (len(ids) % 1024 or 1024) if k == 0 else 1024
            expect[(i, k, start, n, zlib.crc32(ids[start : start + n].tobytes()))] += 1
            start, k = start + n, k + 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expect
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) <= 1.1 * -(-sum(r.length for r in got) // 1024) + 1


def test_base_counts_of_quality_rules(spark, odd_dir):
    got = collections.Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in quality_rules.judge(spark.read.parquet(f"{odd_dir}/documents.parquet"), None).collect()
    )
    expect = collections.Counter()
    for i, text in texts_of(spark, odd_dir):
        words = WORD.findall(text)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        count = collections.Counter(windows)
        repeated = len({k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(5)})
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 10 or 100 * repeated > 20 * len(words)
        expect[(i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, failed)] += 1
    assert got == expect


def test_repeated_lines_and_windows():
    (block,) = X.blocks(pa.array(["a b c d e\nx\na b c d e\n\nx\n", "x\nx"]))
    table = quality_rules.line_table(block)
    assert table["n_dup_lines"].tolist() == [2, 1]
    assert table["n_repeat_words"].tolist() == [12, 0]


def test_license_base_places():
    text = license_scan.reduced("X under the MIT license; CC-BY-NC, cc by nc. Apache License, Version 2.0 under the mit license".encode())
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "x under the mit license; cc-by-nc, cc by nc. apache license, version 2.0 under the mit license")
    expect = sorted((k, label) for phrase, label in license_scan.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
    assert license_scan.base_places(text) == expect
    found = [r.label for _, _, r in license_scan.detect(license_scan.reduced(b"This is licensed under the GNU General Public License version 3."), license_scan.signatures())]
    assert found == ["gpl-3"]


def test_crf_against_enumeration():
    rng = np.random.default_rng(0)
    bounds = np.array([0, 4, 4, 5, 10])
    scores, moves = rng.normal(size=(10, 2)), rng.normal(size=(2, 2))
    p, _, _ = crf.forward_backward(scores, moves, bounds)
    best = crf.viterbi(scores, moves, bounds)
    for a, b in zip(bounds, bounds[1:]):
        if a == b:
            continue
        weight = {}
        for states in itertools.product((0, 1), repeat=b - a):
            weight[states] = sum(scores[a + i, s] for i, s in enumerate(states)) + sum(moves[x, y] for x, y in zip(states, states[1:]))
        assert tuple(best[a:b]) == max(weight, key=weight.get)
        total = sum(np.exp(v) for v in weight.values())
        for i in range(b - a):
            assert np.isclose(p[a + i, 1], sum(np.exp(v) for s, v in weight.items() if s[i]) / total)


def test_neutral_runs_leave_marginals_unchanged():
    rng = np.random.default_rng(1)
    chain = crf.Crf(rng.normal(size=(toxicity.N_BINS, 2)), rng.normal(size=(2, 2)))
    (block,) = X.blocks(pa.array(["aa bad cc dd ee bad gg hh", "zz", "bad"]))
    words, features = toxicity.token_features(block)
    model = toxicity.ToxicModel(np.sort(features[1:2, 0]), np.array([3]), chain, np.zeros(3))
    pos, got = toxicity.marginals(model, words, features)
    whole, _, _ = crf.forward_backward(chain.scores(model.token_bins(features)), chain.moves, words.bounds)
    assert np.allclose(got, whole[pos, 1])


def test_html_text():
    nodes, pieces = html_extract.parse("<body><div class='x'>One &amp;\n two<p>Three<br>four<p>five</div><script>no</script><!-- no --><span id='s'>six</span>")
    assert html_extract.text_of(pieces, np.ones(len(nodes), dtype=bool)) == "One & two\nThree four\nfive\nsix"
    rng = np.random.default_rng(0)
    odds = rng.normal(size=len(nodes))
    picked = html_extract.decode(nodes, odds)
    index = {id(n): i for i, n in enumerate(nodes)}
    allowed = [c for c in itertools.product((False, True), repeat=len(nodes)) if c[0] and all(not c[i] or c[index[id(n.parent)]] for i, n in enumerate(nodes) if n.parent)]
    assert np.isclose((odds * picked)[1:].sum(), max((odds * np.array(c))[1:].sum() for c in allowed))


def test_articles_of_odd_pages(spark, odd_dir):
    for r in html_extract.op4_html_extraction(spark, odd_dir).collect():
        if r.page_id is not None and r.page_id < 40:
            assert "Buy now" not in r.text and "Home" not in r.text and " & more again" in r.text and r.text.count("\n") == 2


@pytest.mark.parametrize("text", ["", "123 !", None])
def test_language_without_letters(spark, text):
    docs = spark.createDataFrame([(1, "en", "the cat and the dog"), (2, "de", "der hund und die katze")], "doc_id long, lang string, text string")
    model = language_id.learn(docs.select("lang", "text"))
    out = language_id.predict(spark.createDataFrame([(7, text), (8, "und die katze")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in out] == ["und", "de"]
