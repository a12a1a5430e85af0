"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

from duosignal.llm.licenses import PHRASES, TEMPLATES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JACCARD = f"""with recursive
W as (select doc_id, list_filter(string_split_regex({_LOWER}, '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') as w from documents),
S as (select distinct doc_id, array_to_string(w[i : i + 2], ' ') as g from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) as i from W where len(w) > 0)),
N as (select W.doc_id, count(g) as n, md5(coalesce(string_agg(g, '|' order by g), '')) as sig from W left join S on S.doc_id = W.doc_id group by W.doc_id),
O as (select a.doc_id as a, b.doc_id as b, count(*) as o from S a join S b on a.g = b.g and a.doc_id <> b.doc_id group by all),
K as (select a, b, x.sig as sa, y.sig as sb from O join N x on x.doc_id = a join N y on y.doc_id = b where 100 * o >= 90 * (x.n + y.n - o)),
R as (select doc_id as d, doc_id as c from N union select R.d, K.b from R join K on K.a = R.c),
D as (select a, count(distinct sb) filter (sb <> sa) as n_links from K group by a)
select N.doc_id, n as n_shingles, min(c) as component_id, coalesce(any_value(n_links), 0) as n_links
from N join R on R.d = N.doc_id left join D on D.a = N.doc_id group by N.doc_id, n"""


def _licenses() -> str:
    templates = ", ".join(f"('{label}', '{label} {i}', '{text}')" for label, texts in sorted(TEMPLATES.items()) for i, text in enumerate(texts))
    phrases = ", ".join(f"('{label}', '{phrase}', {len(phrase.split())})" for phrase, label in PHRASES.items())
    return f"""with W as (select doc_id, list_filter(string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
I as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from W where len(w) > 0),
B as (select doc_id, i - 1 as pos, label from I join (values {phrases}) f(label, phrase, k) on array_to_string(w[i : i + k - 1], ' ') = phrase),
T as (select label, template, len(v) - 2 as size, array_to_string(v[p : p + 2], ' ') as g, p - 1 as place from (select label, template, v, unnest(range(1, len(v) - 1)) as p from (select label, template, string_split(t, ' ') as v from (values {templates}) f(label, template, t)))),
H as (select distinct doc_id, label, template, size, i - 1 as pos, place, i - 1 - place as d from I join T on T.g = array_to_string(w[i : i + 2], ' ') where i <= len(w) - 2),
G as (select *, case when abs(d - lag(d) over o) > 3 or pos - lag(pos) over o > 40 or lag(d) over o is null then 1 else 0 end as n from H window o as (partition by doc_id, template order by pos, d)),
S as (select *, sum(n) over (partition by doc_id, template order by pos, d) as span from G),
V as (select doc_id, label, template, span, size, count(distinct place) as found from S group by all having count(distinct place) >= size * 0.6),
A as (select doc_id, label from V union select doc_id, label from B),
L as (select doc_id, string_agg(label, ',' order by label) as labels from A group by doc_id),
C as (select doc_id, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, string_agg(distinct label, ',' order by label) as base_labels from B group by doc_id),
M as (select doc_id, max(found / size) as best from V group by doc_id)
select W.doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
case when n_base > 0 then 1.0e0 else coalesce(best, 0.0e0) end as score
from W left join C on C.doc_id = W.doc_id left join L on L.doc_id = W.doc_id left join M on M.doc_id = W.doc_id"""


LICENSE_SCANS = _licenses()


def _crc32(text: str) -> str:
    """The unsigned crc32 of a string's UTF-8 bytes, four bits at a time, low ones first."""
    steps = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        steps.append(f"{i}::bigint")
    digits = f"hex(encode({text}))"
    nibbles = f"[(instr('0123456789ABCDEF', substr({digits}, k + 1 - 2 * (k % 2) + 1, 1)) - 1)::bigint for k in range(length({digits}))]"
    return f"xor(list_reduce({nibbles}, lambda c, x: xor(c >> 4, ([{', '.join(steps)}])[(xor(c, x) & 15) + 1]), 4294967295::bigint), 4294967295::bigint)"


SPELLING_VARIANTS = f"""with recursive
R as (select doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents),
D as (select doc_id, run, count(*) as n from R group by all),
H as (select run, n, {_crc32("coalesce(doc_id::varchar, '') || ':' || run")} as h from D),
T as (select n, case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from H),
V as (select word, sum(n)::bigint as n from T where length(word) >= 5 group by word having sum(n) >= 3),
K as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from V)),
P as (select a.word, b.word as other, b.n as m from K a join K b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select K.word, V.word, V.n from K join V on K.rest = V.word union select V.word, K.word, K.n from K join V on K.rest = V.word),
B as (select word, other, m, count(*) over (partition by word) as n_near, row_number() over (partition by word order by m desc, other) as place from P),
F as (select V.word, V.n, coalesce(n_near, 0)::bigint as n_near, case when m >= 2 * V.n then other end as form, case when m >= 2 * V.n then m end as form_n from V left join B on B.word = V.word and place = 1),
C as (select word, word as last, form as onward from F union all select C.word, F.word, F.form from C join F on F.word = C.onward)
select F.word, form, last as root, n, n_near, form_n from F join C on C.word = F.word and C.onward is null"""


def _features(name: str, key: str) -> str:
    """Tables of the words and of the features (runs of one or two words) of a table's texts."""
    return f"""{name}_w as (select {key} as id, list_filter(string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from {name}),
{name}_f as (select id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from {name}_w)"""


IMPORTANCE_RESAMPLING = f"""with {_features("documents", "doc_id")}, {_features("benchmark", "item_id")},
B as (select f, ({_crc32("f")} % 10000)::int as bucket from (select f from documents_f union select f from benchmark_f)),
S as (select bucket, count(*) as s from documents_f join B using (f) group by bucket),
T as (select bucket, count(*) as t from benchmark_f join B using (f) group by bucket),
N as (select (select count(*) from documents_f) as s_all, (select count(*) from benchmark_f) as t_all),
G as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::bigint as gain from S left join T using (bucket), N),
D as (select id, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight from documents_f join B using (f) join G using (bucket) group by id),
H as (select id as doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, list_reduce([(instr('0123456789abcdef', c) - 1)::bigint for c in string_split(substr(sha256('7:' || id), 1, 8), '')], lambda x, y: x * 16 + y) as h from documents_w left join D using (id)),
R as (select doc_id, n_words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from H),
K as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_words >= 20) as n from R)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 25 * n // 100 then place end as rank from K"""
