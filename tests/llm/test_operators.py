"""Every operator against a plain version on small and odd inputs: nulls, empty and long texts, ties, repeats, extra columns."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphspark.llm import components, decontaminate, deleted_interpolation, exact_dedup, html_text, kneser_ney, mixing, near_dedup, personal_data, queries, sharding, token_counts

LONG = "lorem ipsum dolor " * 4000
ODD = [
    (0, "the quick brown fox jumps over the lazy dog and runs away from it all", "a"), (1, None, "a"), (2, "", None), (3, " \t\n", "b"), (4, LONG, "b"),
    (5, "the quick brown fox jumps over the lazy dog and runs away from it all", "b"), (5, "the quick brown fox jumps over the lazy dog and runs away from it all", "b"),
    (None, "no key here", "a"), (None, None, None), (6, "a  b\tc", "c"), (7, "a b c", "c"), (8, "Ünïcödé 😀 中文 text", "a"), (9, "x" * 30000, "a"),
]
#: Columns whose names operators use inside; they must come back as they were.
EXTRA = "size spans shard n key row nth digest copies kept _text _base _added _proposed _email _digest _copies _own _nth _copy _key _source _hash _chunk _bits _n _id _lang words index".split()
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in EXTRA)


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with extra columns whose names operators use inside."""
    return spark.createDataFrame([(*r, *range(len(EXTRA))) for r in ODD], SCHEMA)


def untouched(df, *but):
    """Whether all extra columns but some hold what the fixture gave them."""
    return all(r[c] == k for r in df.collect() for k, c in enumerate(EXTRA) if c not in but)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet")


def jump(key, shards):
    key, b, j = key & (1 << 64) - 1, -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(5, 3000, 61)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 24, 25):
        assert [r[0] for r in df.select(sharding.jump_hash(F.col("k"), shards)).collect()] == [jump(k, shards) for k in keys]


def test_sharding(odd, none):
    rows = sharding.assign(odd, 3, buckets=4).collect()
    expected = Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), jump(-1 if k is None else k, 3), jump(-1 if k is None else k, 4)) for k, t, _ in ODD)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in rows) == expected
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.assign(odd.repartition(5), 3, buckets=4).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and sharding.assign(none, 3).count() == 0


def test_token_counts(odd, none):
    sentencepiece = pytest.importorskip("sentencepiece")
    tokenizers = pytest.importorskip("public_tokenizers")
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    more = odd.sparkSession.createDataFrame([(100 + i, t) for i, t in enumerate(["▁x ▁", "<s>a</s>", "a\nb\t c  ", "  lead", "\x00\x01\x7f", "é́ ﬁ　x", "\n\n"])], "doc_id long, text string")
    got = token_counts.count_tokens(odd.select("doc_id", "text").union(more), tokenizers.path("piece_bpe_32k.model"), limit=100).collect()
    assert len(got) == len(ODD) + 7
    for r in got:
        assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), len(model.encode(r.text or ""))) and r.over_limit == (r.n_tokens > 100)
    assert token_counts.count_tokens(none, tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_grace_hash_splits_until_tables_fit(tmp_path):
    records = [(hash_ % 7 << 60 | hash_, b"content %d" % hash_, hash_, 1) for hash_ in range(500)] * 2
    seen: dict[bytes, int] = {}
    tables = list(exact_dedup.grace(records, 5000, str(tmp_path)))
    for table in tables:
        for _, content, _, copies in table.records():
            assert content not in seen
            seen[content] = copies
    assert len(tables) > 16 and set(seen.values()) == {2} and len(seen) == 500 and not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_equal_hashes_are_told_apart_by_content():
    table = exact_dedup.ContentTable()
    for content in (b"a", b"b", b"a"):
        table.add(1, content, 5, 1)
    assert list(table.records()) == [(1, b"a", 5, 2), (1, b"b", 5, 1)]


@pytest.mark.parametrize("table_bytes", [1000, 48 << 20])
def test_exact_dedup(odd, none, table_bytes):
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for k, t, _ in ODD:
        groups[normal(t)].append(k)
    got = exact_dedup.decide(odd, table_bytes=table_bytes).collect()
    least = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    expected = Counter((k, least[normal(t)], len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for k, t, _ in ODD)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.decide(none).count() == 0


PERSONAL = [
    "mail a.b@c.org, a@b.c_x@y.z or a@b", "1.2.3.4 and 1.2.3.256 and 1.2.3.4.5.6.7.8", "4111 1111 1111 1111, 4111-1111-1111-1112, 4111111111111111 4111111111111111",
    "call +1 (017) 555-7713 or +12345678", "😀é x@y.com at 10.0.0.1", "9" * 3000, "a." * 5000 + "@x.y", "1 " * 3000, "+" + "(" * 500, "Mr. John Smith, 12 Main Street, ssn 123-45-6789", None, "",
]


def base_spans(text):
    out = []
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for order, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(digits[::-1][::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[::-1][1::2])
            fine = {"email": True, "ip": all(int(p) < 256 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if fine[kind]:
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def test_personal_data(spark, odd, none):
    df = spark.createDataFrame([(i, t, "other") for i, t in enumerate(PERSONAL)], "doc_id long, text string, spans string")
    rows = personal_data.find(df).collect()
    assert len(rows) == len(PERSONAL)
    for r in rows:
        base = base_spans(r.text or "")
        told = [f"{k}:{a}:{b}" for a, _, b, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for *_, k in base) for x in personal_data.BASE]
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if s.split(":")[0] in personal_data.BASE] == told
    [people] = [r for r in rows if r.text and "Smith" in r.text]
    assert {s.split(":")[0] for s in people.spans.split(",")} == {"name", "address", "ssn"}
    assert personal_data.find(odd).count() == len(ODD) and personal_data.find(none).count() == 0
    assert untouched(personal_data.find(odd), "spans") and set(odd.columns) <= set(personal_data.find(odd).columns)


def test_many_spans_in_one_text_take_linear_time(spark):
    """A hundred thousand addresses, more than chunks of running sums, with proposals beside and across them."""
    import time

    text = " ".join(f"10.{k % 250}.{k // 250 % 250}.7 x" for k in range(100_000))
    began = time.time()
    [row] = personal_data.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), columns=("doc_id",)).collect()
    assert row.n_ip == row.n_spans == 100_000 and row.asDict().keys() >= {"doc_id", "n_spans"} and "text" not in row.asDict()
    assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(text)).encode()).hexdigest()
    assert time.time() - began < 120


def test_running_and_apart_agree_with_plain_loops(spark, monkeypatch):
    import itertools

    monkeypatch.setattr(personal_data, "CHUNK", 3)
    rng = np.random.default_rng(6)
    span = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
    rows = []
    for n in range(30):
        cuts = np.unique(rng.integers(0, 60, n)).tolist()
        spans = [(a, b, "m", "", "") for a, b in zip(cuts[::2], cuts[1::2])]
        others = [(int(a), int(a + k), "m", "", "") for a, k in zip(rng.integers(0, 60, n // 4), rng.integers(1, 9, n // 4))]
        rows.append((n, spans, others, rng.integers(0, 9, n).tolist()))
    df = spark.createDataFrame(rows, f"id int, spans {span}, others {span}, numbers array<int>")
    for r in personal_data.apart(df, "spans", F.col("others")).collect():
        _, spans, others, _ = rows[r.id]
        assert [tuple(s) for s in r.spans] == [s for s in spans if not any(o[0] < s[1] and s[0] < o[1] for o in others)]
    for r in df.select("numbers", personal_data.running(F.col("numbers"), 0, lambda a, b: a + b).alias("sums")).collect():
        assert r.sums == list(itertools.accumulate(r.numbers, initial=0))[:-1]


def test_added_spans_against_planted_ones(spark):
    """Precision and recall of the added kinds on texts with planted data among look-alikes; a base kind wins an overlap."""
    rng, rows, planted = np.random.default_rng(4), [], {}
    words = "the of and report shows that values are listed below in order".split()
    filler = lambda n: " ".join(rng.choice(words, n))
    hexes = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    for i in range(240):
        kind, value, lead = [
            ("secret", hexes(40), 'token = "'), ("secret", "AKIA" + "".join(rng.choice(list("ABCDEFGHIJ234567"), 16)), "key "), ("ssn", f"{rng.integers(100, 660)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}", "ssn "),
            ("phone_local", f"({rng.integers(201, 990)}) 555-{rng.integers(1000, 9999)}", "phone "), ("iban", "DE89 3704 0044 0532 0130 00", "account "), ("", "", ""),
            ("", "version 3-14-1592", ""), ("", "a = bbbbbbbbbbbbbbbbbbbb", ""),
        ][i % 8]
        before = f"{filler(12)} {lead}"
        rows.append((i, f"{before}{value} {filler(10)}"))
        planted[i] = {f"{kind}:{len(before)}:{len(before) + len(value)}"} if kind else set()
    got = {r.doc_id: set(r.spans.split(",")) - {""} for r in personal_data.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right = sum(len(got[i] & planted[i]) for i in got)
    assert right >= 0.95 * sum(map(len, planted.values())) and right >= 0.95 * sum(map(len, got.values()))


def test_reliabilities_follow_agreement():
    right = [("name", (1, 1, 1, 0, 0, 0), 2, 0, 400), ("name", (-1, -1, -1, 0, 0, 0), 2, 0, 400), ("name", (1, 1, -1, 0, -1, 0), 2, 0, 40), ("name", (-1, -1, 1, 0, 1, 0), 2, 0, 40)]
    model = personal_data.fit(right)
    assert model.reliability["form"] > model.reliability["gazetteer"] > 0.5
    assert model.votes["form"] > 0 and model.votes["gazetteer"] > 0


def hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        i = words(t)
        for k in range(max(1, len(i) - 12)) if i else []:
            window = i[k : k + 13]
            for s in range(len(w) - len(window) + 1):
                if w[s : s + len(window)] == window:
                    hit |= set(range(s, s + len(window)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark, odd, none):
    items = [(1, "Quick, BROWN fox"), (10, "lorem"), (2, None), (3, "..."), (4, ODD[0][1] + " or so they say in the old books of the town"), (1, "Quick, BROWN fox"), (7, "runs away from it all today")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(odd, benchmark).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == Counter((k, *hits(t, items)) for k, t, _ in ODD)
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(odd, benchmark.limit(0)).collect())
    assert untouched(decontaminate.contamination(odd, benchmark))
    nameless = [*items, (None, "jumps over"), (None, "x y z")]
    rows = decontaminate.contamination(odd, spark.createDataFrame(nameless, "item_id long, text string")).collect()
    assert {r.n_items for r in rows if r.doc_id == 0} == {hits(ODD[0][1], items)[2] + 1} and {r.items_sha256 for r in rows if r.doc_id == 0} == {hits(ODD[0][1], items)[3]}


def test_decontamination_by_shuffled_joins_and_full_filters(spark, docs, monkeypatch):
    """Windows of whole documents as items, more than a small bitmap can tell apart, without any broadcast join."""
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 8)
    monkeypatch.setattr(decontaminate, "PLACES", 7)
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").limit(40).collect()]
    items = [(k, " ".join(t.split()[3 : 3 + 5 * k])) for k, t in rows[:25]] + [(99, "the"), (98, "the of"), (97, rows[30][1][:5000])]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted((k, *hits(t, items)) for k, t in rows)
    assert sum(r.n_hit > 0 for r in got) > 10


def counted_shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def probability_jaccard(x, y):
    both, all_ = x.keys() & y.keys(), x.keys() | y.keys()
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in all_) for i in both)


def brute_classes(rows, similarity=0.8, weightings=("set", "count")):
    """Classes by the similarity of word shingles over all pairs, the greatest of the weightings."""
    counts = [counted_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def alike(i, j):
        x, y = counts[i], counts[j]
        both = len(x.keys() & y.keys())
        if (rows[i][1] or "") == (rows[j][1] or "") or "set" in weightings and both and both >= similarity * len(x.keys() | y.keys()) - 1e-12:
            return True
        return "count" in weightings and both > 0 and (max(x.values()) > 1 or max(y.values()) > 1 or weightings == ("count",)) and probability_jaccard(x, y) >= similarity - 1e-9

    for i in range(len(rows)):
        for j in range(i):
            if root(i) != root(j) and alike(i, j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return sorted(sorted(str(rows[i][0]) for i in range(len(rows)) if root(i) == r) for r in {root(i) for i in range(len(rows))})


def class_members(df, **settings):
    members = defaultdict(list)
    for r in near_dedup.classes(df, **settings).collect():
        members[r.class_id].append(str(r.doc_id))
    return sorted(sorted(m) for m in members.values())


def test_near_dedup(spark, docs, odd, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    words = rows[3][1].split()
    for n in range(30):  # a family of near copies, each from the one before, so only neighbours are alike
        words = [*words]
        words[(7 * n) % len(words)] = f"new{n}"
        rows.append((10_000 + n, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.classes(df).collect()
    members = defaultdict(list)
    for r in got:
        members[r.class_id].append(str(r.doc_id))
    assert sorted(sorted(m) for m in members.values()) == brute_classes(rows)
    assert all(r.class_size == len(members[r.class_id]) for r in got) and sum(r.kept for r in got) == len(members)
    assert all(r.doc_id == r.class_id for r in got if r.kept)
    assert near_dedup.keep_one(df).count() == len(members)
    assert near_dedup.keep_one(none).count() == 0 and near_dedup.keep_one(none).columns == none.columns
    some = near_dedup.classes(odd).collect()
    assert len(some) == len(ODD) and sum(r.kept for r in some) == len({r.class_id for r in some}) == near_dedup.keep_one(odd).count()
    assert near_dedup.keep_one(odd).columns == odd.columns and untouched(near_dedup.keep_one(odd)) and near_dedup.classes(none).count() == 0


@pytest.mark.parametrize("weightings", [("set", "count"), ("set",), ("count",)])
def test_near_dedup_links_by_the_similarity_it_signs(spark, weightings):
    rows = []
    for p in range(10):
        words = [f"p{p}w{k}" for k in range(300)]
        changed = [f"z{k}" if k in (30, 90, 150, 210) else w for k, w in enumerate(words)]
        rows += [(2 * p, " ".join(words)), (2 * p + 1, " ".join(changed + words[:20] * 200))]  # alike as sets
    for p in range(5):
        line = " ".join(f"c{p}x{k}" for k in range(12)) + "\n"
        rows += [(100 + 2 * p + s, line * 100 + " ".join(f"u{p}{s}{k}" for k in range(60))) for s in (0, 1)]  # alike by counts
    got = class_members(spark.createDataFrame(rows, "doc_id long, text string"), weightings=weightings)
    assert got == brute_classes(rows, weightings=weightings) and len(got) == 10 * (1 + ("set" not in weightings)) + 5 * (1 + ("count" not in weightings))


def test_near_dedup_joins_components_in_blocks(spark, monkeypatch):
    """Classes of several components, dealt to blocks of two rows, come out as brute force has them."""
    rng, rows = np.random.default_rng(2), []
    base = [f"w{k}" for k in range(400)]
    for n in range(40):
        words = list(base)
        for k in rng.choice(400, n % 14, replace=False):
            words[k] = f"new{n}x{k}"
        rows.append((n, " ".join(words)))
    monkeypatch.setattr(near_dedup._suspected, "__defaults__", (2,))
    monkeypatch.setattr(near_dedup._proved, "__defaults__", (2, 1000))
    assert class_members(spark.createDataFrame(rows, "doc_id long, text string")) == brute_classes(rows)


def test_merged_components(spark):
    rng = np.random.default_rng(8)
    first, more = ([(int(a), int(b)) for a, b in rng.integers(0, 90, (n, 2)) if a != b] for n in (40, 25))
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    labels = components.merged_components(components.connected_components(frame(first)), frame(more))
    whole = components.connected_components(frame(first + more))
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, whole.collect()))
    assert components.merged_components(labels.limit(0), frame([])).count() == 0


def test_members_of_many_stars_take_one_edge_each(spark, monkeypatch):
    """Nodes under the same forty leaders go round with an edge for each node, not for each leader of it."""
    rng, written, store = np.random.default_rng(5), Counter(), components.materialise

    def counting(df, name):
        out = store(df, name)
        written[name] = max(written[name], out.count())
        return out

    monkeypatch.setattr(components, "materialise", counting)
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    rows = [(lead, node) if node % 2 else (node, lead) for node in range(100, 500) for lead in range(0, 80, 2) if lead < 70 or node > 300] + [(901, 900), (903, 903)]
    rows = [rows[k] for k in rng.permutation(len(rows))]
    expected = {n: 0 for n in [*range(0, 80, 2), *range(100, 500)]} | {900: 900, 901: 900, 903: 903}
    assert dict(map(tuple, components.connected_components(frame(rows)).collect())) == expected
    assert 0 < written["edges"] <= 2 * len(expected) < len(rows)
    first = components.connected_components(frame(rows[:50]))
    assert dict(map(tuple, components.merged_components(first, frame(rows)).collect())) == expected
    for n in (30, 60, 200):
        pairs, label = [(int(a), int(b)) for a, b in rng.integers(0, 100, (n, 2))], {}
        for x in {x for p in pairs for x in p}:
            label[x] = x
        for _ in pairs:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        assert dict(map(tuple, components.connected_components(frame(pairs)).collect())) == label


def test_dealt_blocks_hold_every_pair_across_components(spark):
    rows = [("g", n, 1 if n < 30 else n, 10) for n in range(37)] + [("h", n, 5, 10) for n in range(100, 120)]
    dealt = near_dedup._dealt(spark.createDataFrame(rows, "bucket string, node long, component long, size long"), "bucket", 4, 1000).collect()
    tasks = defaultdict(lambda: ([], []))
    for r in dealt:
        tasks[r.bucket, r.i, r.j][not r.left].append(r.node)
    met = {frozenset((a, b)) for lefts, rights in tasks.values() for a in lefts for b in rights if a != b}
    component = {n: c for _, n, c, _ in rows}
    assert {r.bucket for r in dealt} == {"g"} and met >= {frozenset((a, b)) for a in range(37) for b in range(a) if component[a] != component[b]}
    assert sum(r.left for r in dealt) == 7 * len({j for g, _, j in tasks})


def test_registers_estimate_similarity():
    import pyarrow as pa

    words = [f"w{k}" for k in range(400)]
    texts = pa.array([" ".join(words), " ".join(words[:360] + words[:40] * 9)])
    text, value, count = near_dedup.shingles(texts)
    by_set = near_dedup.signatures(2, text, value, np.ones(len(value)), registers=2000)
    by_count = near_dedup.signatures(2, text, value, count, registers=2000)
    exact = probability_jaccard(*(counted_shingles(t) for t in texts.to_pylist()))
    assert abs((by_set[0] == by_set[1]).mean() - near_dedup.jaccard(texts[:1], texts[1:])[0]) < 0.05
    assert abs((by_count[0] == by_count[1]).mean() - exact) < 0.05
    left, right = near_dedup.shingles(texts[:1]), near_dedup.shingles(texts[1:])
    assert math.isclose(near_dedup.similarities(left, right, 1, ("count",))[0], exact)


def test_repeated_lines_do_not_hide_a_copy(spark):
    def text(d, times):
        lines = [" ".join(f"d{d}w{k}x{j}" for j in range(8)) for k in range(40)]
        return "\n".join(line for k, line in enumerate(lines) for _ in range(times if k < 8 else 1))

    rows = [(2 * d + k, text(d, times)) for d in range(12) for k, times in enumerate((2, 1000))]
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    members = defaultdict(list)
    for r in got:
        members[r.class_id].append(str(r.doc_id))
    assert sorted(sorted(m) for m in members.values()) == brute_classes(rows)
    assert len(members) == 12


def test_common_shingles():
    of, value = np.array([0, 0, 0, 1, 1, 2]), np.array([5, 6, 7, 6, 7, 9], dtype=np.uint64)
    assert near_dedup.common_shingles(of, value, np.array([0, 2]), np.array([1, 2]), width=2).tolist() == [[2, 0], [0, 1]]


def plain_targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full = set()
    while True:
        free = [s for s in names if s not in full]
        level = (share * sum(sizes.values()) - sum(most * sizes[s] for s in full)) / (sum(weight[s] for s in free) or 1)
        new = {s for s in free if level * weight[s] > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in names}
        full |= new


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1000, None: 10, "c": 0}, {}, {"x": 0}, {None: 7}, {f"s{k}": (k * k * 37) % 1013 for k in range(200)} | {"Z": 5, "é": 9, "😀": 4, "\uffff": 3}])
def test_targets(spark, sizes):
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    expected = plain_targets(sizes)
    assert [r.source for r in sorted(got, key=lambda r: r.no)] == list(expected) and [r.no for r in sorted(got, key=lambda r: r.no)] == list(range(len(sizes)))
    assert all(math.isclose(r.target, expected[r.source], rel_tol=1e-9, abs_tol=1e-9) for r in got)


def test_small_sources_land_as_near_as_any_choice_can(spark):
    """Sources of few documents against all choices of documents that the expected copies allow."""
    import itertools

    rng = np.random.default_rng(12)
    rows = [(k, " ".join(["w"] * int(rng.integers(1, 60))), f"s{k % 4}") for k in range(36)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in {s for *_, s in rows}:
        own = [r for r in mixed if r.source == source]
        rate = own[0].target / own[0].source_size
        whole, chance = int(rate + 1e-9), rate - int(rate + 1e-9)
        off = lambda extra: abs(sum(e * r.size for e, r in zip(extra, own)) - chance * own[0].source_size) + abs(sum(extra) - chance * len(own))
        assert math.isclose(off([r.copies - whole for r in own]), min(off(x) for x in itertools.product((0, 1), repeat=len(own))), abs_tol=1e-6)


def test_draws_have_the_chances_asked_for():
    size = np.array([50, 40, 33, 20, 12, 9, 5, 3])
    chance = np.array([0.1, 0.5, 0.25, 0.7, 0.9, 0.3, 0.6, 0.4])
    mean = np.mean([mixing.fly(size, chance, s) for s in range(3000)], axis=0)
    assert np.allclose(mean, chance, atol=0.04)


def test_alike_rows_spread_over_blocks(spark):
    rows = [(1, "same words here", "a")] * 500 + [(k, "other words", "b") for k in range(2, 40)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=20)
    got = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    assert {r.source: r.n for r in got} == {"a": 500, "b": 38} and all(abs(r.taken - r.target) <= 0.02 * r.target + 3 for r in got)


def test_flight_keeps_the_totals():
    size = np.sort(np.random.default_rng(1).integers(1, 500, 300))[::-1]
    chance = np.full(300, 0.37)
    out = mixing.fly(size, chance, 3)
    assert np.isclose(out.sum(), chance.sum()) and np.isclose((out * size).sum(), (chance * size).sum()) and ((out > 0) & (out < 1)).sum() <= 2
    held = mixing.fly_holding(size, chance, 3)
    landed = mixing.land(size, held)
    assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - (chance * size).sum()) < 2


@pytest.mark.parametrize("block", [5, 4000])
def test_mixing(docs, odd, none, block):
    mixed = mixing.mix(docs, block=block).collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect()}
    assert {r.doc_id: r.size for r in mixed} == size and all(0 <= r.taken <= 2 * r.size for r in mixed)
    taken, goal = Counter(), {}
    for r in mixed:
        taken[r.source] += r.taken
        goal[r.source] = (r.target, r.source_size)
    # In blocks of five documents the landing problem has few ways to choose from.
    assert all(abs(taken[s] - t) <= (0.3 if block == 5 else 0.05) * max(t, 200) for s, (t, _) in goal.items())
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7), block=block).collect()}
    assert again == {(r.doc_id, r.taken) for r in mixed}
    whole = mixing.mix(odd, block=block)
    assert whole.count() == len(ODD) and mixing.take(odd, whole).count() == sum(r.copies for r in whole.collect())
    assert mixing.take(odd, whole).columns == odd.columns and untouched(mixing.take(odd, whole)) and mixing.mix(none).count() == 0
    assert mixing.take(none, mixing.mix(none)).count() == 0


def test_deleted_interpolation(spark, docs, odd, none):
    df = odd.select("doc_id", "text").union(docs.select("doc_id", "text"))
    rows = [(k, [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "</s>"]) for k, t in ((r.doc_id, r.text) for r in df.collect())]
    fold = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 5
    counts = Counter(w for k, ws in rows if fold(k) != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = Counter((k, fold(k) == 1, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for k, ws in rows)
    got = deleted_interpolation.score(df, chunk_bytes=50_000, shard_bytes=100_000).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == expected
    assert all(-1e9 < r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert deleted_interpolation.score(none).count() == 0


def interpolated(rows):
    """The model over (key, text) rows from plain counts: a function of context and word, and the score of every row."""
    fold = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 5
    texts = [(fold(k), ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "</s>"]) for k, t in rows]

    def estimates(folds):
        pairs = Counter(p for f, ws in texts if f in folds for p in zip(ws, ws[1:]))
        words, contexts = Counter(), Counter()
        for (v, w), n in pairs.items():
            words[w] += n
            contexts[v] += n
        total = max(1, sum(words.values()))
        return (lambda v, w: pairs[v, w] / contexts[v] if contexts[v] else 0.0), (lambda w: words[w] / total), contexts, words

    bucket = lambda n: int(deleted_interpolation.bucket(np.array([n]))[0])
    steps = lambda p: int(deleted_interpolation._steps(np.array([p]))[0])
    two, one, contexts, words = estimates({0, 2, 3})
    events = Counter((bucket(contexts[v]), steps(two(v, w)), steps(one(w))) for f, ws in texts if f == 4 for v, w in zip(ws, ws[1:]))
    weights = deleted_interpolation.learn_weights([(*e, n) for e, n in events.items()], len(words))
    two, one, contexts, words = estimates({0, 2, 3, 4})

    def probability(v, w):
        a, b, c = weights[bucket(contexts[v])]
        return a * two(v, w) + b * one(w) + c / (len(words) + 1)

    return probability, contexts, words, [sum(math.log10(probability(v, w)) for v, w in zip(ws, ws[1:])) for _, ws in texts]


def test_interpolated_scores_agree_with_brute_force(spark, docs, odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").union(docs.select("doc_id", "text")).collect()]
    probability, contexts, words, scores = interpolated(rows)
    got = deleted_interpolation.score(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=50_000, shard_bytes=100_000).collect()
    assert sorted((str(k), round(s, 6)) for (k, _), s in zip(rows, scores, strict=True)) == sorted((str(r.doc_id), round(r.score, 6)) for r in got)
    for v in [w for w, _ in contexts.most_common(3)] + [min(contexts, key=contexts.get)]:
        assert math.isclose(sum(probability(v, w) for w in words) + probability(v, "never seen"), 1, rel_tol=1e-9)


def test_weights_find_the_better_estimate():
    steps = lambda p: round(-deleted_interpolation.STEPS * math.log2(p))
    w = deleted_interpolation.learn_weights([(5, steps(0.5), steps(0.01), 1000), (9, deleted_interpolation.NEVER, steps(0.1), 1000)], 100)
    assert w[5][0] > 0.95 and w[9][1] > 0.9 and np.allclose(w.sum(axis=1), 1)


def test_kneser_ney_is_a_distribution(spark):
    model = kneser_ney.train(spark.createDataFrame([("abracadabra",), ("banana bread",), ("cab",)], "text string"), "text")
    rows = {(r.ord, r.part, r.key): r.value for r in model.table.collect()}
    letters = sorted({k for o, p, k in rows if o == 1 and p == "alpha"})
    assert math.isclose(model.floor, 1 / (len(letters) + 1))
    known = [g for o, p, g in rows if o == 4 and p == "gamma"]
    context = known[0]
    asked = spark.createDataFrame([((context << 16) | x,) for x in [*letters, 0x7FFF]], "gram long")
    total = sum(2 ** -r.bits for r in kneser_ney.log_probabilities(asked, model).collect())
    assert math.isclose(total, 1, rel_tol=1e-9)


def plain_kneser_ney(texts, order=4):
    """Bits of a text under interpolated modified Kneser-Ney over runs of characters, from plain counts."""
    runs = lambda t: [("\1" * (order - 1) + t + "\2")[k : k + order] for k in range(len(t) + 1)]
    counts, levels = Counter(g for t in texts for g in runs(t)), {}
    for k in range(order, 0, -1):
        n = [0] + [sum(c == j for c in counts.values()) for j in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [0.0] + [min(j, max(0.1 * j, j - (j + 1) * y * n[j + 1] / n[j])) if n[j] else 0.5 * j for j in (1, 2, 3)]
        total, less = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            less[g[:-1]] += d[min(c, 3)]
        levels[k] = ({g: (c - d[min(c, 3)]) / total[g[:-1]] for g, c in counts.items()}, {h: less[h] / total[h] for h in total})
        kinds = len(counts)
        counts = Counter(g[1:] for g in counts)

    def probability(g):
        p = 1 / (kinds + 1)
        for k in range(1, order + 1):
            own = g[order - k :]
            p = levels[k][0].get(own, 0.0) + levels[k][1].get(own[:-1], 1.0) * p
        return p

    return lambda t: (-sum(math.log2(probability(g)) for g in runs(t)), len(t) + 1)


def test_quality_agrees_with_brute_force(spark, small_dir, docs):
    """Perplexities, bits and thresholds from plain counts, quantiles by numpy."""
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    got = kneser_ney.judge(docs, labels, least=10, quantile=0.9).collect()
    learnt = {r.id for r in kneser_ney.training_ids(labels, "doc_id", "quality", 20_000).collect()}
    text = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    bits = plain_kneser_ney([text[k][0] for k in learnt if k in text])
    found = {k: bits(t) for k, (t, _) in text.items()}
    assert learnt and all(math.isclose(r.perplexity, 2 ** (found[r.doc_id][0] / found[r.doc_id][1]), rel_tol=1e-5) for r in got)
    unseen = [r.doc_id for r in labels.where("quality = 1").collect() if r.doc_id not in learnt and r.doc_id in text]
    groups = {lang: [k for k in unseen if text[k][1] == lang] for _, lang in text.values()}
    own = lambda lang: groups[lang] if len(groups[lang]) >= 10 else unseen
    prior = kneser_ney.PRIOR_CHARACTERS
    centre = lambda lang: sum(found[k][0] for k in own(lang)) / sum(found[k][1] for k in own(lang))
    shrunk = lambda k: (found[k][0] + prior * centre(text[k][1])) / (found[k][1] + prior)
    for r in got:
        limit = np.quantile([shrunk(k) for k in own(r.lang)], 0.9)
        assert math.isclose(r.quality_bits, shrunk(r.doc_id), rel_tol=1e-5) and math.isclose(r.threshold, limit, rel_tol=1e-5)
        assert r.kept == (shrunk(r.doc_id) <= limit) or math.isclose(shrunk(r.doc_id), limit, rel_tol=1e-5)


def test_quality_joins_on_keys_only(spark, small_dir, docs):
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    plan = kneser_ney.judge(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_grams():
    import pyarrow as pa

    grams, n = kneser_ney.grams(pa.array(["ab", None, "😀", ""]))
    assert n.tolist() == [3, 1, 2, 1] and len(grams) == 7
    assert grams[0] == 1 << 48 | 1 << 32 | 1 << 16 | ord("a") and grams[2] == 1 << 48 | ord("a") << 32 | ord("b") << 16 | 2


def test_quality(spark, small_dir, docs, odd, none):
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    junk = spark.createDataFrame([(10_000 + k, "$$$ ### " * 30 + str(k), "en", "x", 250) for k in range(5)], docs.schema)
    got = kneser_ney.judge(docs.union(junk), labels).join(labels.where("quality = 1").select("doc_id", "quality"), "doc_id", "left").collect()
    trusted = [r for r in got if r.quality == 1]
    assert len(got) == docs.count() + 5 and sum(r.kept for r in trusted) >= 0.95 * len(trusted)
    assert not any(r.kept for r in got if r.doc_id >= 10_000)
    strange = odd.withColumn("lang", F.lit(None).cast("string"))
    assert untouched(kneser_ney.judge(strange, labels), "kept")
    judged = kneser_ney.judge(strange, labels).collect()
    assert len(judged) == len(ODD) and not any(r.kept for r in judged if not r.text)
    assert kneser_ney.judge(none.withColumn("lang", F.lit("en")), labels).count() == 0
    untrained = kneser_ney.judge(strange, labels.limit(0)).collect()
    assert [r.kept for r in untrained] == [bool(r.text) for r in untrained]


def test_thresholds_cover_all_trusted_documents(spark):
    rng = np.random.default_rng(3)
    word = lambda letters: "".join(rng.choice(list(letters), 4))
    rows = [(k, " ".join(word("abc" if k % 10 else "pqrstuvwxyz") for _ in range(60)), "aa" if k % 10 else "zz") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    got = kneser_ney.judge(docs, labels, trusted=50).collect()
    limits = {r.lang: r.threshold for r in got}
    assert len(got) == len(rows) and limits["zz"] > 1.2 * limits["aa"]  # a language of 90 documents has its own threshold
    for name in ("aa", "zz"):
        own = [r for r in got if r.lang == name]
        assert {r.threshold for r in own} == {limits[name]} and 0.97 * len(own) <= sum(r.kept for r in own) < len(own)


def test_model_learns_from_all_trusted_documents(spark, monkeypatch):
    """Four fifths of 30,000, whether their ids are broadcast at once, in pieces or not at all."""
    docs = spark.range(30_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("en").alias("lang"))
    labels = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    learnt = []

    def train(sample, text):
        learnt.append({r[0] for r in sample.collect()})
        raise InterruptedError

    monkeypatch.setattr(kneser_ney, "train", train)
    for piece, pieces in ((1 << 20, 8), (9_000, 8), (1_000, 8)):
        monkeypatch.setattr(kneser_ney, "LEARNT_PIECE", piece, raising=False)
        monkeypatch.setattr(kneser_ney, "LEARNT_PIECES", pieces, raising=False)
        with pytest.raises(InterruptedError):
            kneser_ney.judge(docs, labels)
    hashed = docs.where("doc_id < 30000").where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) != 0)
    expected = {r.text for r in hashed.select("text").collect()}
    assert learnt == [expected] * 3 and 23_500 < len(expected) < 24_500


def test_text_that_is_not_asked_for_moves_once(spark, small_dir, docs):
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    got = queries.op7_kneser_ney(spark, small_dir)
    whole = kneser_ney.judge(docs, labels)
    last = got._jdf.queryExecution().executedPlan().toString()
    assert "text" in whole._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in last.splitlines() if "named_struct" in line and re.search(r"\btext\b", line[line.index("named_struct"):].split(" AS row")[0])]
    assert sorted((r.doc_id, r.kept) for r in got.collect()) == sorted((r.doc_id, r.kept) for r in whole.collect())


def test_quantiles_are_exact(spark):
    values = np.random.default_rng(4).normal(3, 0.4, 500)
    rows = [("a" if k % 3 else "b" if k % 2 else None, float(round(v, 3))) for k, v in enumerate(values)] + [("c", 9.0)] * 3
    found = kneser_ney.quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", 0.995, 50)
    assert set(found) == {"a", "b", None}
    for name in found:
        assert math.isclose(found[name], np.quantile([v for g, v in rows if name in (g, None)], 0.995))


HTML = [
    ("<article><h1>T &amp; x</h1><p>a <b>b</b>\n c<br>d<p>e<ul><li>1<li>2</ul><div class='share'>s</div><section id=comments>zz</section></article><footer>f</footer>", "T & x\na b c d\ne\n1\n2"),
    ("<div>hello <p>a < b</p> x &lt;p&gt;<script>var a='</p>'</script> y<!-- c --></div><div class='cookie-notice'>n</div><form>f</form>", "hello\na < b\nx <p> y"),
    ("<p title='a>b'>t</p><a href=\"x>y</a><p>z</p>", "t\ny\nz"), ("plain text", "plain text"), ("", ""), (None, ""), ("<p>un<closed", "un<closed"),
    ("<main class=with-sidebar><p>a</p><div class='no-ads content'>b</div><div class=adBox>c</div></main><article class=comment>d</article>", "a\nb"),
    ("<article><p>a</p><section id=\"related-work\"><p>b</p></section><div class=\"comment-policy-explained\">c</div><p class=\"alert\">d</p><p>e <math>x</math> <button>f</button> <span aria-hidden=true>g</span></p></article>", "a\nb\nc\nd\ne x f g"),
    ("<div class=\"post share-enabled\"><p>whole body</p></div><div class='share-buttons'>s</div><div id=related-posts>r</div><button>b</button>", "whole body"),
    ("<article><div class='ad-box'>x</div><div class=cookieNotice>y</div><section id=menu><h2>Menu</h2>dishes</section><div id=comments>z</div></article>", "Menu\ndishes"),
    ("<header>site</header><main><header><h2>Head</h2><span>by</span></header>body</main>", "Head\nbody"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
]


@pytest.mark.parametrize(("source", "text"), HTML)
def test_main_text(source, text):
    assert "\n".join(t for t, _ in html_text.blocks_and_keys("http://h/x", source)) == text


def test_templates_go_by_host(spark):
    rows = [(i, f"http://H.com/{i}", f"<div class=top><p>welcome</p></div><div><p>Own text {i}</p></div><div>Same foot</div>", "x") for i in range(20)]
    rows += [(100, "http://o.com/1", "<div><p>welcome</p></div><p>t", "x"), (None, None, None, None), (3, "http://H.com/3", rows[3][2], "x")]
    copies = [(200 + i, "http://c.com/x", "<article><p>the same article</p></article>", "x") for i in range(8)]
    got = html_text.extract(spark.createDataFrame(rows + copies, "page_id long, url string, html string, text string")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) + 8 and all(text[i] == f"Own text {i}" for i in range(20)) and text[100] == "welcome\nt" and text[None] == ""
    assert all(text[200 + i] == "the same article" for i in range(8)) and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_recurrence_decides_outside_the_article(spark):
    page = "<body><a href=/>Home</a><div class=wrap><div><p>All offers</p></div><article><p>Text {0}</p></article><div><p>Errata {0}</p></div></div>See also</body>"
    rows = [(i, f"http://h.com/{i}", page.format(i)) for i in range(20)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Text {i}\nErrata {i}" for i in range(20)}


def test_templates_go_by_different_main_texts(spark):
    section = "<div><p>Part of the section</p></div>"
    rows = [(i, f"http://big.com/{i}", f"{section if i % 20 == 0 else ''}<article><p>Text {i}</p></article>") for i in range(200)]
    rows += [(1000 + i, f"http://big.com/a{i}", f"<div>Short note</div><table><tr><td>Yes<td>Value {i}</table>" if i < 6 else f"<p>Plain {i}</p>") for i in range(100)]
    rows += [(2000 + i, f"http://few.com/{i}", "<article><h1>Copy</h1><section>Its body</section></article>") for i in range(8)]
    rows += [(2100 + i, f"http://few.com/b{i}", f"<article><section>Same note</section><p>Other {i}</p></article>") for i in range(8)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(text[i] == f"Text {i}" for i in range(200))
    assert all(text[1000 + i] == (f"Yes\nValue {i}" if i < 6 else f"Plain {i}") for i in range(100))
    assert all(text[2000 + i] == "Copy\nIts body" and text[2100 + i] == f"Other {i}" for i in range(8))


def test_counting_agrees_with_brute_force(spark):
    """Whole subtrees, marked or not, per host: what recurs beside five different main texts goes."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(120):
        host = f"h{i % 3}.com" if i < 90 else f"s{i}.com"
        nav = f"<nav><a>Menu {rng.integers(4)}</a></nav>"
        note = f"<div><b>Note</b> {rng.integers(12)}</div>"
        rows.append((i, f"http://{host}/{i}", f"<body>{nav}{note}<article><p>Text {i % 40}</p><div>Box {rng.integers(9)}</div></article></body>"))
    texts = defaultdict(set)
    pieces = {i: [(x, re.search(r"//([^/]*)", u)[1]) for x in re.findall(r"<nav>.*?</nav>|<div>.*?</div>", h)] for i, u, h in rows}
    kept = {i: [] for i, *_ in rows}
    plain = lambda x: re.sub("<[^>]*>", "", x)
    for i, _, h in rows:
        for x in pieces[i]:
            # The main text of a page is all in its article, its own box included.
            texts[x].add((f"Text {i % 40}", plain(pieces[i][-1][0])))
    for i, *_ in rows:
        kept[i] = [f"Text {i % 40}" if k == 2 else plain(pieces[i][k if k < 2 else 2][0]) for k in (1, 2, 3) if k == 2 or len(texts[pieces[i][1 if k == 1 else 2]]) < 5]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == {i: "\n".join(x) for i, x in kept.items()}
    on_pages = Counter(x for i in pieces for x in set(pieces[i]))
    found = Counter((r.texts, r.pages) for r in html_text.templates(df).collect())
    assert found == Counter((len(t), on_pages[x]) for x, t in texts.items() if len(t) >= 5) and sum(found.values()) > 20


def test_subtree_hashes_cover_the_whole_subtree():
    import itertools

    pages = ["<div><b>a</b>c</div>", "<div><i>a</i>c</div>", "<div>a<b>c</b></div>", "<div class=x><b>a</b>c</div>", "<div><b>a</b><b></b>c</div>"]
    hashes = [html_text.subtree_hashes(html_text.parse(p), 1)[1] for p in pages]
    assert all(a != b for a, b in itertools.combinations(hashes, 2))
    assert html_text.subtree_hashes(html_text.parse("<div>\n<b id=k> a </b> c</div>"), 1)[1] == hashes[0]


def test_unclosed_tags_take_linear_time():
    import time

    began = time.process_time()
    assert html_text.blocks_and_keys(None, "<a " * 200_000)[0][0].startswith("<a <a")
    assert html_text.blocks_and_keys(None, "<a " * 200_000 + ">x")[0][0] == "x"
    assert time.process_time() - began < 10


def test_deep_nesting_and_long_pages():
    assert "\n".join(t for t, _ in html_text.blocks_and_keys(None, "<div>" * 3000 + "x" + "</div>" * 3000)) == "x"
    assert len(html_text.blocks_and_keys(None, "<p>word</p>" * 20000)) == 20000
