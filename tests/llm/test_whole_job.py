"""Cases in which an operator once did less than the whole job."""

import random
import re
import zlib
from re import _parser as parser

import numpy as np
import pytest

from subdiv.llm import decontaminate, html_extract, license_scan, packing, toxicity
from tests.llm.test_brute_force import edits


def edited(rng, words, kind, n):
    """The words after n edits of a kind, at places as even as they come."""
    at = sorted(rng.sample(range(len(words)), n), reverse=True)
    out = list(words)
    for i in at:
        what = rng.choice(["change", "insert", "delete"]) if kind == "mixed" else kind
        out[i : i + (what != "insert")] = [] if what == "delete" else [f"new{rng.randrange(10**6)}"]
    return out


@pytest.mark.parametrize("kind", ["change", "insert", "delete", "mixed"])
def test_every_leak_at_the_edit_limit_is_found(spark, kind):
    rng = random.Random(kind)
    lengths = [1, 4, 5, 9, 10, 15, 20, 25, 40, 48, 59]
    items = [[f"i{k}x{rng.randrange(40)}" for _ in range(n)] for k, n in enumerate(lengths)]
    rows, truth = [], {}
    for k, item in enumerate(items):
        limit = int(0.2 * len(item))
        for _ in range(30):
            lead, tail = ([f"f{rng.randrange(50)}" for _ in range(rng.randrange(70))] for _ in range(2))
            words = lead + edited(rng, item, kind, limit) + tail
            truth[len(rows), k] = edits(item, words)
            rows.append((len(rows), " ".join(words)))
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.distance for r in found}
    recall = {len(items[k]): sum(got.get(t) is not None for t in truth if t[1] == k) / 30 for k in range(len(items))}
    assert got == truth, recall


def example(rng, parsed):
    """A text that a parsed regular expression of the rules matches."""
    out = ""
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                out += chr(arg)
            case "IN":
                out += rng.choice("0123456789") if str(arg[0][0]) == "CATEGORY" else chr(rng.choice(arg)[1])
            case "MAX_REPEAT":
                out += "".join(example(rng, arg[2]) for _ in range(rng.randint(*arg[:2])))
            case "SUBPATTERN":
                out += example(rng, arg[3])
            case "BRANCH":
                out += example(rng, rng.choice(arg[1]))
            case "ASSERT" | "ASSERT_NOT":
                pass
            case other:
                raise ValueError(other)
    return out


def test_every_license_rule_is_reached_by_scan(spark):
    rng, rules, texts = random.Random(6), license_scan.signatures(), []
    for rule in rules:
        for _ in range(6):
            text = example(rng, parser.parse(rule.pattern.pattern))
            assert rule.keyword in text and rule.pattern.search(f" x {text} y ")
            texts.append("X, " + re.sub(" ", lambda _: rng.choice([" ", "  ", "-", ", "]), text.upper()) + ". y")
    texts += ["released under the gpl version 3", "distributed under the bsd 3 clause", "this work is governed by the apache 2 0 terms", "published under mpl 2 0", "no words of that kind"]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: (r.labels, len(r.detections)) for r in rows}
    for i, text in enumerate(texts):
        found = license_scan.detect(license_scan.reduced(text.encode()), rules)
        base = {label for _, label in license_scan.base_places(license_scan.reduced(text.encode()))}
        assert got[i] == (",".join(sorted(base | {r.label for _, _, r in found})), len(found)), text
    assert [got[len(texts) - k][0] for k in (5, 4, 3, 2, 1)] == ["gpl-3", "bsd-3", "apache-2", "mpl-2", ""]
    assert all(got[i][1] for i in range(len(texts) - 1))


def test_ids_of_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    added = "<|endoftext|>"
    texts = [f"end {added} start", added, f"a  {added}{added}  \n b", "<|endoftext|", f"x{added}'s 12", "<|ENDOFTEXT|>", f"\n\n{added} ü"]
    got = {r.doc_id: (r.start, r.length, r.ids_crc32) for r in packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        assert got[i] == (0, len(ids), zlib.crc32(ids.tobytes())), text
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [437, 220, 50256, 923]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p>a</p><svg-icon name="x"></svg-icon><p>b</p></article>', "a\nb"),
        ("<p>a</p><object-view><p>b</p></object-view><p>c</p>", "a\nb\nc"),
        ('<p>a</p><svg class="i"/><p>b</p><p>c</p>', "a\nb\nc"),
        ('<p>a</p><svg class="i" /><p>b</p><svg><title>t</title></svg><p>c</p>', "a\nb\nc"),
        *[(f"<p>a</p><{name} id='i'><p>b</p><p>c</p>", "a\nb\nc") for name in ("template", "noscript", "svg", "iframe", "object", "canvas")],
        *[(f"<p>a</p><{name} id='i'>no</{name.upper()} ><p>c</p>", "a\nc") for name in ("template", "noscript", "svg", "iframe", "object", "canvas", "script", "style", "textarea", "title")],
        *[(f"<p>a</p><{name}>no<p>no</p>", "a") for name in ("script", "style", "textarea", "title")],
        ("<p>a</p><script>x<y</script><svg>no</svg><svg><p>b</p>", "a\nb"),
        ("<p>a</p><svg data-x='1>2'>no</svg>b", "a\nb"),
    ],
)
def test_text_after_elements_without_text(page, text):
    nodes, pieces = html_extract.parse(page)
    assert html_extract.text_of(pieces, np.ones(len(nodes), dtype=bool)) == text


@pytest.mark.parametrize(("n_toxic", "n_tail"), [(200, 5), (1000, 31)])
def test_rare_toxic_words_count_in_samples_of_any_size(spark, n_toxic, n_tail):
    rng = random.Random(9)

    def word():
        return "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(4))

    tail, plain = [word() for _ in range(n_tail)], [word() for _ in range(300)]

    def text(*bad):
        words = [*bad, *rng.choices(plain, k=20)]
        rng.shuffle(words)
        return " ".join(words)

    rows = [(text("idiot"), 1) for _ in range(n_toxic // 2)] + [(text(tail[i % n_tail]), 1) for i in range(n_toxic // 2)]
    rows += [(text(), 0) for _ in range(n_toxic)]
    model = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"))
    held_out = [("idiot", text("idiot")) for _ in range(20)] + [("tail", text(w)) for w in tail for _ in range(4)] + [("clean", text()) for _ in range(200)]
    scores = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame([(i, True, x) for i, (_, x) in enumerate(held_out)], "doc_id long, held_out boolean, text string"), model).collect()}
    share = {kind: sum(scores[i] for i, (k, _) in enumerate(held_out) if k == kind) / sum(k == kind for k, _ in held_out) for kind in ("idiot", "tail", "clean")}
    assert share["idiot"] == 1 and share["tail"] >= 0.9 and share["clean"] <= 0.05, share
