"""Fill-in-middle, quality rules and periodic runs below their queries."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_contract import all_runs

from factloom.llm import fim, periodic
from factloom.llm import quality_rules as rules


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab\n é漢😀", max_size=30), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), min_size=1, max_size=8), st.sampled_from([fim.LINES, fim.CHARS]), st.integers(0, 2))
def test_cuts_of_a_batch(rows, units, skip):
    """All rows together as each by itself, also of a slice of a batch."""
    texts = pa.array(["x\ny"] * skip + [t for t, _, _ in rows])[skip:]
    forms = [(fim.PLAIN, fim.PSM, fim.SPM)[h1 % 3] if t else fim.PLAIN for t, h1, _ in rows]
    n, before, middle, output = fim.transform_batch(texts, np.asarray([r[1:] for r in rows], np.int64), forms, units)
    for k, (t, h1, h2) in enumerate(rows):
        parts = re.findall(r"[^\n]*\n|[^\n]+", t) if units == fim.LINES else list(t)
        a, b = sorted((h1 % (len(parts) + 1), h2 % (len(parts) + 1)))
        p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
        plain = forms[k] == fim.PLAIN
        assert n[k].as_py() == len(parts) and before[k].as_py() == (None if plain else len(p)) and middle[k].as_py() == (None if plain else len(m))
        assert output[k].as_py() == {fim.PLAIN: t, fim.PSM: f"<P>{p}<S>{s}<M>{m}", fim.SPM: f"<S>{s}<P>{p}<M>{m}"}[forms[k]]


def test_round_trip_and_shares(spark):
    rows = [(i, None, "x") if i == 0 else (i, "<" * (i % 4) + f"S>\n<P line {i}\n\n" + "é\n" * (i % 50), "x") for i in range(2000)] + [(1, "has <M> inside", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    out = fim.fill_in_middle(docs, fim_percent=60, spm_percent=25).withColumn("text2", fim.restored()).collect()
    texts = {i: t or "" for i, t, _ in rows[:2000]}
    assert all(r["text2"] in (texts[r["doc_id"]], "has <M> inside") for r in out) and len(out) == 2001
    share = lambda f: sum(r["form"] == f for r in out) / 2001
    marked = sum("<S>" in t for t in texts.values()) / 2001
    assert abs(share("plain") - 0.4 - 0.6 * marked) < 0.05 and abs(share("spm") - 0.25 * (1 - share("plain"))) < 0.04
    chars = {r["doc_id"]: r["n"] for r in fim.fill_in_middle(docs.where("doc_id > 5"), units=fim.CHARS).collect()}
    assert all(n == len(texts[i]) for i, n in chars.items())
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, units="words")


def test_null_columns_and_other_id_types(spark):
    docs = spark.createDataFrame([(None, None), ("a", "x\ny")], "doc_id string, text string")
    assert {r["doc_id"]: r["n"] for r in fim.fill_in_middle(docs).collect()} == {None: 0, "a": 2}
    assert {r["doc_id"]: r["collapsed"] for r in periodic.find_runs(docs).collect()} == {None: "", "a": "x y"}


def test_runs_of_random_texts():
    """Periodic stretches at random places among few words, nested and side by side."""
    rng = random.Random(5)
    docs = []
    for _ in range(300):
        words = []
        while len(words) < rng.randint(0, 160):
            if rng.random() < 0.5:
                words += [rng.choice("abc") for _ in range(rng.randint(1, 15))]
            else:
                unit = [rng.choice("abcde") for _ in range(rng.randint(1, 12))]
                words += (unit * 20)[: rng.randint(1, 5 * len(unit) + 20)]
        docs.append([w.encode() for w in words])
    doc, start, length, period = periodic.find(docs)
    got = {}
    for row in zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        got.setdefault(row[0], []).append(row[1:])
    for k, words in enumerate(docs):
        assert got.get(k, []) == all_runs(words), words
    assert sum(map(len, got.values())) > 200


def test_chunks_of_the_grid(monkeypatch):
    words = [[b"x"] * 500, [b"a", b"b"] * 100 + [b"c"], [b"a"] * 23]
    whole = [x.tolist() for x in periodic.find(words)]
    monkeypatch.setattr(periodic, "CHUNK", 7)
    assert [x.tolist() for x in periodic.find(words)] == whole == [[0, 1], [0, 0], [500, 200], [1, 2]]


def test_long_periodic_text_is_searched_whole():
    unit = [str(i).encode() for i in range(9000)]
    words = unit * 30 + [b"end"]
    assert [x.tolist() for x in periodic.find([words])] == [[0], [0], [270_000], [9000]]
    assert [x.tolist() for x in periodic.find([[b"w"] * 200_000])] == [[0], [0], [200_000], [1]]


def test_exact_comparison_of_exponents(spark):
    rows = [(1, [(0, 49, 16), (60, 98, 32), (5, 30, 10)]), (2, [(3, 60, 20), (9, 30, 10)]), (3, [])]
    df = spark.createDataFrame(rows, "id long, runs array<struct<start: long, length: long, period: long>>")
    assert [tuple(r["b"]) if r["b"] else None for r in df.orderBy("id").selectExpr(f"{periodic.longest()} AS b").collect()] == [(0, 49, 16), (3, 60, 20), None]


SITE = "Subscribe to our newsletter now"


def body(i, n=60):
    return " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{k}" for k in range(n))


def rules_rows():
    rows = [(i, f"{body(i)}\n{SITE.upper() if i % 2 else SITE}", "site") for i in range(40)]
    rows += [(100 + i, f"{body(200 + i)}\n{SITE}", None) for i in range(11)]  # a host without a name, just above the limit
    rows += [(200 + i, f"{body(300 + i)}\n{SITE}", "small") for i in range(10)]  # ten documents are not above ten
    rows += [(300 + i, f"{body(400)}\ncopied line", "copies") for i in range(50)]  # one document, many copies
    rows += [(400, f"{SITE}\n" * 30 + body(500, 24), "site"), (401, None, "site"), (402, "few words", "site")]
    return rows + [(403, "buy it now " * 40, "site")]


@pytest.mark.parametrize("few", [True, False])
def test_lines_that_many_documents_share(spark, monkeypatch, few):
    if not few:  # the join that a long list of frequent lines takes, with hot lines dealt to tasks
        monkeypatch.setattr(rules, "BROADCAST_IDS", 0)
        monkeypatch.setattr("factloom.llm.common.HOT_ROWS", 4)
    docs = spark.createDataFrame(rules_rows(), "doc_id long, text string, source string").withColumn("h", F.lit(1))
    got = {r["doc_id"]: r for r in rules.judge(docs).collect()}
    removed = {i: r["removed_words"] for i, r in got.items() if r["removed_words"]}
    assert removed == {**{i: 5 for i in range(40)}, **{100 + i: 5 for i in range(11)}, 400: 150}
    assert {i for i, r in got.items() if not r["kept"]} == {400, 401, 402, 403}  # depleted, empty, short, repeated
    assert {i for i, r in got.items() if r["base_failed"]} == {400, 401, 402, 403}
    clean = {r["doc_id"]: r for r in rules.clean_documents(docs).collect()}
    assert set(clean) == {i for i, r in got.items() if r["kept"]} and all(r["h"] == 1 for r in clean.values())
    texts = {i: t for i, t, _ in rules_rows()}
    for i, r in clean.items():
        assert r["text"] == (texts[i].rsplit("\n", 1)[0] if i in removed else texts[i])


def test_depleted_documents_go(spark):
    rows = [(i, f"{body(i, 20)}\n" + "\n".join(" ".join(f"menu{chr(97 + k)}{chr(97 + j)}" for j in range(7)) for k in range(12)), "s") for i in range(30)]
    got = rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(not r["base_failed"] and not r["kept"] and r["removed_words"] == 84 for r in got)
    kept = rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), least_left=15).collect()
    assert all(r["kept"] for r in kept)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=40))
def test_words_of_repeated_windows(words):
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    want = {k + o for k, w in enumerate(windows) if windows.count(w) > 1 for o in range(3)}
    assert rules.repeated_words([w.encode() for w in words]) == len(want)
