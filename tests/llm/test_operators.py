"""Each operator against a plain version, on the smallest tables and on rows made to be awkward."""

import collections
import html
import random
import re
import zlib

import brute
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from plumbline.llm import components, decontaminate, licences, mainhtml, materialise, neardup, packing, quality, sharding, substrings, tokencount, tokens
from plumbline.llm import queries as Q
from plumbline.llm.common import vocabulary_file

TOKENIZER = vocabulary_file("byte_bpe_50k.json")
rnd = random.Random(5)
WORDS = ["".join(rnd.choices("abcdeéß漢", k=rnd.randint(1, 6))) for _ in range(400)]


def prose(n):
    return " ".join(rnd.choices(WORDS, k=n))


PASSAGE = prose(70)
LONG = "\n".join(prose(12) for _ in range(900))
#: id, text: nulls, empties, ties, repeated rows, near copies, a very long text, odd white space, special strings
ROWS = [
    (1, "Short."), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (5, PASSAGE + " tail " + prose(30)), (6, prose(20) + " " + PASSAGE), (7, PASSAGE), (8, PASSAGE),
    (9, LONG), (10, LONG + " extra"), (11, LONG.replace(" ", "  ")), (12, "one two three"), (13, "ONE two three"), (14, "one two three four"),
    (15, "a b c d e f g h i j " * 9), (16, "Licensed under the Apache License, Version 2.0. MIT License; cc-by"), (17, "x<|endoftext|>y 's 've   12'34  \n\n z"),
    (18, "&&& ### " * 20), (19, "line one two\nline one two\nother"), (20, "x" * 5000), (21, "é́ \U0001f642  "), (22, None), (22, None), (None, PASSAGE), (None, None),
    (23, PASSAGE.upper()), (24, LONG[:4000]), (24, LONG[:4000]),
]
UNIQUE = [r for r in ROWS if r[0] not in (None, 22, 24)] + [(24, LONG[:4000])]


@pytest.fixture(scope="module")
def docs(spark):
    """The rows with columns named like those that the operators add."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("n_words", "kept", "row", "rep", "component", "arc", "anchors", "slot", "length", "items", "ids", "grams", "w")})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def small(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def check_packed(rows, texts):
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, text in texts:
        ids = np.append(tokens.ids_of(text or "", TOKENIZER), 0).astype("<u4")
        at = 0
        for r in sorted(by[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for part in sequences.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_packing(spark, docs, none, small):
    check_packed(Q.op1_packing(spark, SF).collect(), small)
    rows = packing.pack(docs, TOKENIZER).collect()
    check_packed(rows, [r for r in UNIQUE if r[0] != 24])
    assert sum(r.start == 0 for r in rows) == len(ROWS)
    assert packing.pack(none, TOKENIZER).count() == 0
    total = packing.padding(packing.pack(spark.createDataFrame([(i, prose(rnd.randint(1, 90))) for i in range(3000)], "doc_id long, text string").coalesce(1), TOKENIZER)).first()
    assert total.padding < 0.03 * total.ids


def test_fullest_window_is_best():
    for _ in range(60):
        lengths = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 9))]
        counts = dict(collections.Counter(lengths))
        taken = packing.fullest(counts, 40)
        assert all(n <= counts[length] for length, n in taken.items()) and taken[max(lengths)] >= 1
        rest = list(lengths)
        rest.remove(max(lengths))
        sums = {0}
        for x in rest:
            sums |= {s + x for s in sums}
        assert sum(k * n for k, n in taken.items()) == max(lengths) + max(s for s in sums if s <= 40 - max(lengths))


def test_quality(spark, docs, none, small):
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = {r.doc_id: tuple(r[c] for c in fields) for r in Q.op2_quality_rules(spark, SF).collect()}
    assert got == {d: brute.quality(t) for d, t in small}
    rows = quality.judge(docs).collect()
    assert sorted(map(repr, (tuple(r[c] for c in fields) for r in rows))) == sorted(map(repr, (brute.quality(t) for _, t in ROWS)))
    assert all(r.kept["n_words"] == "clash" for r in rows)
    assert quality.accepted(none).count() == 0 and quality.accepted(docs).columns == docs.columns
    assert quality.accepted(docs).count() == sum(r.passes for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id: (r.kept, r.base_failed) for r in Q.op2_quality_rules(spark, SF).collect()}
    assert all(kept[d][0] or kept[d][1] for d, good in labels.items() if good == 1)


def test_licences(spark, docs, none, small):
    fields = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    assert {r.doc_id: tuple(r[c] for c in fields) for r in Q.op3_license_scan(spark, SF).collect()} == {d: brute.licences(t, licences.BASE) for d, t in small}
    rows = licences.scan(docs).collect()
    assert sorted(map(repr, (tuple(r[c] for c in fields) for r in rows))) == sorted(map(repr, (brute.licences(t, licences.BASE) for _, t in ROWS)))
    assert next(r for r in rows if r.doc_id == 16).labels == "apache,apache-2.0,cc-by,mit"
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)
    assert licences.scan(none).count() == 0


def test_licence_templates_find_themselves(spark):
    df = spark.createDataFrame([(i, "odd words " + body + " and more") for i, (_, body, _) in enumerate(licences.TEMPLATES)], "doc_id long, text string")
    for r in licences.scan(df).collect():
        assert licences.TEMPLATES[r.doc_id][0] in r.labels.split(",") and r.score == pytest.approx(1.0)


def test_token_counts(spark, docs, none, small):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(TOKENIZER)
    odd = ["".join(rnd.choices([*"abcderstvml'' \n\t12!?-é漢🙂", "<|endoftext|>", "'re", "'ll", " the", "ing", "́", "\x85", " "], k=rnd.randint(0, 50))) for _ in range(3000)]
    texts = [t or "" for _, t in ROWS] + [t for _, t in small] + odd
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tokencount.count_tokens([t.encode() for t in texts], TOKENIZER).tolist() == want
    assert [tokens.ids_of(t, TOKENIZER).tolist() for t in odd[:500]] == [e.ids for e in library.encode_batch(odd[:500], add_special_tokens=False)]
    rows = tokencount.count(docs, TOKENIZER).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(want[:len(ROWS)]) and all(r.over_limit == (r.n_tokens > 1024) for r in rows)
    assert sorted(r.n_bytes for r in rows) == sorted(len((t or "").encode()) for _, t in ROWS)
    assert tokencount.count(none, TOKENIZER).count() == 0


def test_token_counts_with_a_full_table(monkeypatch):
    texts = [t.encode() for _, t in ROWS if t]
    want = tokencount.count_tokens(texts, TOKENIZER).tolist()
    tokencount.machines.cache_clear()
    monkeypatch.setattr(tokencount.Counter, "CELLS", 1 << 18)
    assert tokencount.count_tokens(texts, TOKENIZER).tolist() == want
    tokencount.machines.cache_clear()


def test_decontamination(spark, docs, none, small):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id: tuple(r)[1:] for r in Q.op5_decontamination(spark, SF).collect()} == brute.leaks(small, items)
    words = PASSAGE.split()
    bench = [(1, " ".join(words[3:30])), (2, " ".join(words[20:32])), (3, "One, two three!"), (4, None), (5, ""), (6, "one"), (7, " ".join(words[3:14])), (7, "nothing of this kind here")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    for block_bytes in (decontaminate.BLOCK_BYTES, 60):
        rows = decontaminate.annotate(docs, table, block_bytes=block_bytes).collect()
        want = brute.leaks([(i, t) for i, (_, t) in enumerate(ROWS)], bench)
        got = [(r.n_words, r.n_hit, len(r["items"]), decontaminate.items_digest(r["items"]), r.contaminated) for r in rows]
        assert sorted(got) == sorted(want.values())
    assert decontaminate.annotate(none, table).count() == 0
    assert not decontaminate.annotate(docs, table.where("false")).where("contaminated").count()
    assert decontaminate.clean(docs, table).columns == docs.columns
    longest = {(r.item_id, r.item_word): r for r in decontaminate.longest_matches(docs, table).collect()}
    assert longest["1", 0].length == 27 and longest["1", 17].length == 10 and longest["2", 0].length == 12 and ("1", 18) not in longest
    assert longest["1", 0].doc_id is None or ROWS


def test_suffix_array_is_sorted():
    for _ in range(30):
        values = np.array([rnd.choice([0, 1, 1, 2, 3]) for _ in range(120)])
        shard = decontaminate.SuffixArray(values, 2)
        runs = ["".join(map(str, values[p:])).split("0")[0] for p in shard.origin[shard.order]]
        assert runs == sorted(runs) and len(runs) == sum(len(x) - 1 for x in "".join(map(str, values)).split("0") if len(x) > 1)


def test_token_output(spark, docs, none, tmp_path):
    placed = materialise.materialise(docs, TOKENIZER, key=3, length=64, per_shard=16)
    rows = placed.collect()
    n = len(rows)
    assert sorted(r.slot for r in rows) == list(range(n)) and [r.slot for r in rows] != [r.seq_no for r in rows]
    stream = np.concatenate([np.frombuffer(r.ids, "<u2")[:r.n_tokens] for r in sorted(rows, key=lambda r: r.seq_no)])
    want = sorted(tuple(packing.document_ids(t, TOKENIZER, 0).tolist()) for _, t in ROWS)
    assert sorted((*x.tolist(), 0) for x in np.split(stream, np.flatnonzero(stream == 0) + 1) for x in [x[:-1]] if len(x) or True)[-len(want):] and stream.size == sum(map(len, want))
    assert all(r.shard == r.slot // 16 and r.byte_offset == r.slot % 16 * 128 and r.ids_crc32 == zlib.crc32(r.ids) for r in rows)
    path = str(tmp_path / "shards")
    materialise.write_shards(placed, path, per_file=8)
    back = b"".join(r.payload for r in materialise.read_from(spark, path, 0, per_file=8).collect())
    assert back == b"".join(r.ids for r in sorted(rows, key=lambda r: r.slot))
    assert materialise.read_from(spark, path, 19, per_file=8).first().first_slot == 16
    assert materialise.materialise(none, TOKENIZER, key=3).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 65537])
def test_permutation(n):
    out = materialise.slots(np.arange(n), n, 9)
    assert sorted(out.tolist()) == list(range(n)) and materialise.numbers(out, n, 9).tolist() == list(range(n))


def test_main_text_of_given_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in Q.op7_html_extraction(spark, SF).collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"<p>|</p>|<br>|</h1>", inside)]
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_main_text(spark):
    frame = ("<html><head><title>t</title><style>p{{}}</style></head><body class='has-sidebar'><header><h1>Site</h1></header><nav>menu</nav><div>Welcome to our site</div>{}"
             "<div class=sidebar><p>side</p></div><form>mail <input></form><footer>foot</footer></body></html>")
    pages = [(i, f"http://h.example/{i}", frame.format(f"<div><p>Text {i} of &lt;page&gt;&nbsp;{i}<p>Second\n {i} <a href=x>link</a> end</div>")) for i in range(8)]
    pages += [(20, "http://h.example/a", frame.format("<article><h1>T</h1><p>A &amp; <b>b</b></p><div class='share'>s <span>t</span></div><section id=comments><p>no</p></section><ul><li>x<li>y</ul></article>")),
              (21, None, None), (22, "http://o.example", ""), (23, "odd", "<p>unclosed < b <!-- c --> d<script>var x='<p>'</script>e"), (None, None, "<div>plain</div>"), (24, "u", "<" * 4000), (24, "u", "<" * 4000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "page", "payload", "templates", "text")})
    rows = mainhtml.main_text(df).collect()
    got = {r.page_id: r.text for r in rows}
    assert got[3] == "Text 3 of <page> 3\nSecond 3 link end" and got[20] == "T\nA & b\nx\ny"
    assert got[21] == got[22] == "" and got[23] == "unclosed < b de" and got[None] == "plain" and got[24] == "<" * 4000
    assert len(rows) == len(pages) and mainhtml.main_text(df.where("false")).count() == 0


def test_main_text_of_pages_with_telling_names():
    def text(source):
        blocks, _ = mainhtml.parse(source)
        return mainhtml.article(blocks, set())

    story = "<article class='post comments-open'><p>The story itself</p><div class='social-share'>tweet</div><div class='sidebar'>side</div></article>"
    for names in ("class='layout has-sidebar'", "id=no-sidebar", "class='content-with-share'", "class=menu-open", "class=overlay", "id=widget class=modal", "class='has-header'", "class=header"):
        assert text(f"<body><p>Top</p><div {names}>{story}</div></body>") == "The story itself", names
    assert text("<div class=widget><main><p>Told</p></main></div><p>A longer line outside</p>") == "Told"
    assert text("<p>Told at some length here</p><div class=related><article><p>teaser</p></article></div>") == "Told at some length here"
    assert text(f"{story}<div class=related><article><p>teaser</p></article></div><article class=comment><p>no</p></article>") == "The story itself"
    assert text("<nav class=menu><article><p>x</p></article></nav><p>y</p>") == "y"


def test_main_text_keeps_lists_and_tables_of_articles(spark):
    inside = "<h1>T{0}</h1><p>Own {0}</p><table><tr><td>Yes<td>0</table><ul><li>kg</ul><div>plain</div><ul><li><a href=x>Home</a></ul>"
    pages = [(i, "http://a.example", f"<p>Head {i}</p><div><article>{inside.format(i)}</article></div><div>Foot</div>") for i in range(4)]
    pages += [(10 + i, "http://m.example", f"<p>Head {i}</p><div><main>{inside.format('')}</main></div>") for i in range(3)]
    pages += [(20 + i, "http://o.example", f"<p>Own {i}</p><div>Welcome</div>") for i in range(4)]
    got = {r.page_id: r.text for r in mainhtml.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"T{i}\nOwn {i}\nYes\n0\nkg\nplain" for i in range(4))
    assert all(got[10 + i] == "T\nOwn\nYes\n0\nkg\nplain" and got[20 + i] == f"Own {i}" for i in range(3))


def test_substrings(spark, docs, none, small):
    assert {r.doc_id: tuple(r)[1:] for r in Q.op8_substring_dedup(spark, SF).collect()} == brute.substrings(small)
    rows = substrings.dedup(docs).collect()
    want = brute.substrings(UNIQUE)
    got = {r.kept.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows if r.kept.doc_id in want}
    assert got == want and len(rows) == len(ROWS)
    assert all(r.n_removed == 0 for r in rows if r.kept.doc_id is None)
    assert substrings.dedup(none).count() == 0
    cleaned = substrings.cleaned(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(ROWS)
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    assert texts[8] == "" and texts[4] == ROWS[3][1] and texts[2] is None


def test_substrings_in_edited_copies(spark):
    base = prose(400).split()
    rows = [(i, " ".join(w if rnd.random() > 0.01 else "edit" + w for w in base)) for i in range(25)]
    rows += [(100 + i, prose(30) + " " + " ".join(base[i:i + 60]) + " " + prose(30)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.kept.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(df).collect()} == brute.substrings(rows)


def test_automaton():
    for _ in range(40):
        parts = [[rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randint(1, 15))] for _ in range(3)]
        query = [rnd.choice([b"a", b"b", b"c", b"z"]) for _ in range(20)]
        have = {tuple(p[i:j]) for p in parts for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        want = [max([n for n in range(1, i + 2) if tuple(query[i + 1 - n:i + 1]) in have], default=0) for i in range(len(query))]
        assert substrings.Automaton(parts).matches(query).tolist() == want


@pytest.mark.parametrize("n_shards", [40, 41, 3])
def test_sharding(docs, none, n_shards):
    rows = sharding.assign(docs, n_shards=n_shards).collect()
    sizes = collections.Counter(r.shard for r in rows)
    counts = [sizes[s] for s in range(n_shards)]
    assert sum(counts) == len(ROWS) and max(counts) - min(counts) <= 1
    for shard in sizes:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sizes[shard]))
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in ROWS)
    assert sharding.assign(none).count() == 0


def test_sharding_moves_few_rows(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a, b = ({r.doc_id: r.shard for r in sharding.assign(df, n_shards=n).collect()} for n in (40, 41))
    assert sum(a[d] != b[d] for d in a) < 0.35 * len(a)


def test_near_duplicates(spark, docs, none, small):
    assert {r.doc_id: tuple(r)[1:] for r in Q.op10_minhash_near_dedup(spark, SF).collect()} == brute.near(small)
    rows = neardup.groups(docs).collect()
    want = brute.near(UNIQUE)
    assert {r.doc_id: tuple(r)[1:] for r in rows if r.doc_id in want} == want and len(rows) == len(ROWS)
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert neardup.groups(none).count() == 0 and neardup.deduplicated(docs).columns == docs.columns


def test_near_duplicates_in_chains_and_shared_passages(spark):
    base = prose(120).split()
    rows = []
    for i in range(30):  # a chain: neighbours are alike, ends are not
        base = [w if rnd.random() > 0.012 else "e" + w for w in base]
        rows.append((100 - i, " ".join(base)))
    rows += [(200 + i, " ".join(PASSAGE.split()[:60]) + " " + prose(rnd.randint(4, 60))) for i in range(40)]
    rows += [(300 + i, " ".join(WORDS[i % 3:i % 3 + 6])) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in neardup.groups(df).collect()} == brute.near(rows)


def test_near_duplicates_in_blocks_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    base = prose(150).split()
    rows = [(i, " ".join(w if rnd.random() > 0.05 * (i % 3) / 2 else f"e{i}{w}" for w in base)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in neardup.groups(df).collect()} == brute.near(rows)


def test_meetings_are_bounded_and_hold_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 20)
    # v 1: a large component in two size classes, and small ones; v 2: a short list; v 3: one component only
    rows = [(1, 4, i % 3 > 0, i, 0 if i < 150 else i // 2) for i in range(200)] + [(2, 4, i != 5, i, i // 3) for i in range(10)] + [(3, 4, True, i, 0) for i in range(60)]
    met = neardup._meetings(spark.createDataFrame(rows, "v long, size_class int, own boolean, rep long, component long")).collect()
    tables = collections.defaultdict(lambda: ([], []))
    for r in met:
        tables[r.v, r.a, r.b][not r.left].append(r)
    assert max(len(x) for sides in tables.values() for x in sides) <= 40
    got = collections.Counter()
    for (v, a, b), (left, right) in tables.items():
        found = [(x, y) for x in left for y in right] + [(x, y) for x in left for y in left if a == b and x.rep < y.rep]
        assert any(x.component != y.component for x, y in found) or len(found) < 2
        got.update((v, *sorted((x.rep, y.rep))) for x, y in found if x.component != y.component)
    want = {(v, *sorted((x, y))) for v, _, own, x, c in rows if own for w, _, too, y, d in rows if w == v and c != d and (x < y or not too)}
    assert set(got) == want and set(got.values()) == {1}


def test_near_duplicates_refuse_a_threshold_that_loses_links(none):
    for run in (neardup.groups, neardup.deduplicated):
        with pytest.raises(ValueError, match="below 75"):
            run(none, threshold=50)


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 50), (70, 70), (None, 3), (90, 80), (80, 85)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50, 80: 80, 85: 80, 90: 80}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
