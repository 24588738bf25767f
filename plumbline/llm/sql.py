"""SQL counterparts of the queries that SQL can express.

Packing, token counts, token output, encoding and decoding need a tokenizer; license labels beyond the base, main texts of pages and
ring positions follow from code or hash functions that SQL does not have. Those are tested against plain versions.
"""

from __future__ import annotations

from plumbline.llm.quality import RULES, STOP_WORDS, SYMBOLS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE_WORD = r"[^\x20\x09-\x0D]+"
_ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(word: str, text: str = "coalesce(text, '')") -> str:
    return f"regexp_extract_all({text}, '{word}')"


def _folded(word: str) -> str:
    return _words(word, f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")


def _rules() -> str:
    tests = []
    for r in RULES:
        over = "1" if r.over is None else f"greatest({r.over}, 1)"
        for bound, sign in ((r.low, ">="), (r.high, "<=")):
            if bound is not None:
                tests.append(f"({r.measure} {sign} {over} * {float(bound)}::double or n_words < {r.at_least})")
    return " and ".join(tests)


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

def _codes() -> str:
    """k-means of four parts in four rounds: assignments a0 to a4, codebooks c0 to c4."""
    steps = []
    for r in range(5):
        steps.append(f"""a{r} as materialized (select part, vec_id, pos, min(d * 256 + entry) % 256 entry, min(d * 256 + entry) // 256 d from (
            select x.part, vec_id, pos, entry, (list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::bigint d from x join c{r} using (part)) group by all)""")
        if r < 4:
            steps.append(f"""c{r + 1} as materialized (select part, entry, case when n is null then c else m end c from c{r} left join (
                select part, entry, any_value(n) n, list(((s - ((s % n) + n) % n) // n)::double order by i) m from (
                    select part, entry, i, sum(x[i])::bigint s, count(*) n from (select part, entry, x, unnest(range(1, len(x) + 1)) i from a{r} join x using (part, vec_id, pos)) group by all) group by part, entry) using (part, entry))""")
    return ",\n".join(steps)


ORACLE: dict[str, str] = {
    "op2_quality_rules": rf"""
with d as (select doc_id, coalesce(text, '') t, {_words(_SPACE_WORD)} w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_SPACE_WORD}')) l from documents),
grams as (select doc_id, i, array_to_string(w[i:i+4], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 3)) i from d where len(w) >= 5)),
again as (select doc_id, g from grams group by all having count(*) > 1),
covered as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + 5)) p from grams join again using (doc_id, g)) group by doc_id),
m as (select d.doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
             (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint n_symbols,
             (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words,
             len(list_filter(w, lambda x: lower(x) in ({_STOPS})))::bigint n_stop_words, len(l)::bigint n_lines,
             len(list_filter(l, lambda x: contains('{SYMBOLS}', left(regexp_extract(x, '{_SPACE_WORD}'), 1))))::bigint n_symbol_lines
      from d left join covered using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from m)
select *, not base_failed and {_rules()} kept from b""",
    "op5_decontamination": rf"""
with d as (select doc_id, {_folded(_ALNUM_WORD)} w from documents),
b as (select coalesce(item_id::varchar, '') item_id, {_folded(_ALNUM_WORD)} w from benchmark),
bw as (select distinct item_id, w[i:i+9] win from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from b where len(w) > 0)),
dw as (select doc_id, i, l, w[i:i+l-1] win from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) i
       from d, (select distinct len(win)::bigint l from bw) where len(w) >= l)),
hits as (select doc_id, i, l, item_id from dw join bw using (win)),
n as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + l)) p from hits) group by doc_id),
t as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) items from (select distinct doc_id, item_id from hits) group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join n using (doc_id) left join t using (doc_id)""",
    "op8_substring_dedup": rf"""
with d as (select doc_id, {_words(_SPACE_WORD)} w from documents),
win as (select doc_id, i, array_to_string(w[i:i+49], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 48)) i from d where len(w) >= 50)),
f as (select s, min(doc_id) f from win group by s having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, unnest(range(i, i + 50)) p from win join f using (s) where f < doc_id),
word as (select doc_id, p, w[p] x from (select doc_id, w, unnest(range(1, len(w) + 1)) p from d)),
k as (select doc_id, count(gone.p) n, string_agg(x, ' ' order by word.p) filter (gone.p is null) kept from word left join gone using (doc_id, p) group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join k using (doc_id)""",
    "op10_minhash_near_dedup": rf"""
with recursive d as (select doc_id, {_folded(_SPACE_WORD)} w from documents),
s as (select distinct doc_id, array_to_string(w[i:i+4], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
c as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b using (g) where a.doc_id < b.doc_id group by all),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l),
r as (select doc_id a, doc_id b from d union select r.a, e.b from r join e on r.b = e.a),
m as (select a doc_id, min(b) component_id from r group by a)
select d.doc_id, coalesce(n, 0)::bigint n_shingles, component_id, d.doc_id = component_id kept from d left join n using (doc_id) join m using (doc_id)""",
    "op11_periodic_runs": rf"""
with c as (select doc_id, coalesce(text, '') t, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
             lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) h from documents),
s as (select doc_id, h, h // 10 g, {_words(_SPACE_WORD, "t")} w from c),
a as (select *, len(w)::bigint n, case when len(w) > 0 then g % len(w) end a from s),
p as (select *, 1 + (n - a) // (3 + g % 8) p from a),
d as (select doc_id, n, case when h % 10 = 0 and n > 0 then w[1:a] || list_transform(range(a, n), lambda i: w[a + (i - a) % p + 1]) else w end w from p),
word as (select doc_id, n, i, w[i + 1] x from (select doc_id, n, w, unnest(range(0, n)) i from d)),
same as (select a.doc_id, b.i - a.i q, a.i from word a join word b on a.doc_id = b.doc_id and a.x = b.x and b.i > a.i and b.i - a.i <= a.n // 4),
island as (select doc_id, q, min(i) s, count(*) + q l from (select *, i - row_number() over (partition by doc_id, q order by i) k from same) group by doc_id, q, k),
r as (select doc_id, s, l, min(q) q from island where l >= greatest(6, 4 * q) group by doc_id, s, l),
gone as (select distinct doc_id, unnest(range(s + q, s + l)) i from r),
lines as (select doc_id, count(*) n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) t from r group by doc_id),
best as (select * from r qualify row_number() over (partition by doc_id order by l::hugeint * 1000000000000 // q desc, s, q) = 1),
kept as (select doc_id, string_agg(x, ' ' order by i) t from word anti join gone using (doc_id, i) group by doc_id)
select d.doc_id, coalesce(n_runs, 0)::bigint n_runs, s::bigint "start", l::bigint length, q::bigint period, (1000 * l // q)::bigint exponent_milli,
       sha256(coalesce(lines.t, '')) runs_sha256, sha256(coalesce(kept.t, '')) collapsed_sha256
from d left join lines using (doc_id) left join best using (doc_id) left join kept using (doc_id)""",
    "op13_vector_codes": f"""
with k as (select vec_id, label, row_number() over (order by vec_id) pos, list_transform(embedding, lambda v: floor(1024 * v::double)) v from embeddings
           where len(embedding) > 0 and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
x as materialized (select vec_id, pos, p part, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] x from k, range(4) t(p)),
c0 as (select part, pos - 1 entry, x c from x where pos <= 256),
{_codes()},
e as (select vec_id, pos, sum(d)::bigint error, string_agg(printf('%02x', entry::bigint), '' order by part) code from a4 group by vec_id, pos),
b as (select sha256(string_agg(array_to_string(list_transform(c, lambda v: v::bigint::varchar), ','), ',' order by part, entry)) h from c4)
select vec_id, code, error, sum(error) over (partition by label)::bigint label_error, h codebooks_sha256 from e join k using (vec_id, pos), b""",
}
