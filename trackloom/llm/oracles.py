"""SQL that says the same as a query, written from the contracts for DuckDB.

SQL has none of the hashes, models, vocabularies or edit distances of the other queries; their tests hold them against plain Python.
"""

from __future__ import annotations

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE = r"[\x20\x09-\x0D]+"

#: Rules from the longest to the shortest; those for hosts with subdomains begin at a label.
OP1 = rf"""
with rest as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
own as (select page_id, regexp_extract(r, '^[^/?#]*') as h, regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') as path from rest),
site as (select page_id, {LOWERED.format("h")} as host, path from own),
ruled as (select *, case
  when regexp_matches(host || path, '^([^/]*\.)?www\.example\.com/en/') then 'www.example.com/en/'
  when regexp_matches(host || path, '^([^/]*\.)?example\.com/en/') then 'example.com/en/'
  when regexp_matches(host || path, '^([^/]*\.)?net/es/') then 'net/es/'
  when regexp_matches(host || path, '^([^/]*\.)?net/fr/') then 'net/fr/'
  when regexp_matches(host || path, '^([^/]*\.)?com/') then 'com/' end as rule from site)
select page_id, host, path, case when host <> '' then rule end as rule, case
  when host = '' then 'block'
  when rule in ('www.example.com/en/', 'com/') then 'allow'
  when rule is not null then 'block'
  when regexp_matches(host || path, '^([^/]*\.)?(spam-farm|cheap-pills|ads-track|casino|doubleclick)\.') then 'block'
  when contains(host || path, '/wp-admin/') or regexp_matches(host || path, '\.([eE][xX][eE]|[aA][pP][kK]|[mM][sS][iI])$') then 'block'
  else 'allow' end as verdict from ruled"""

OP2 = rf"""
with recursive words as (select doc_id, list_filter(regexp_split_to_array({LOWERED.format("coalesce(text, '')")}, '{SPACE}'), lambda x: x <> '') as w from documents),
shingles as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k+3], ' ')) end) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by 1),
sets as (select doc_id, md5(string_agg(s, chr(10) order by s)) as node from shingles group by 1),
classes as (select node, min(doc_id) as doc_id from sets group by 1),
own as (select s.* from shingles s join classes c on s.doc_id = c.doc_id),
links as (select a.doc_id as a, b.doc_id as b from own a join own b on a.s = b.s and a.doc_id < b.doc_id
  join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id where 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  group by 1, 2 having 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
edges as (select a, b from links union select b, a from links),
reach as (select doc_id as a, doc_id as b from classes union select r.a, e.b from reach r join edges e on r.b = e.a),
comps as (select a, min(b) as least from reach group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(least, d.doc_id) as component_id, d.doc_id = coalesce(least, d.doc_id) as kept
from documents d left join sizes z on z.doc_id = d.doc_id left join sets t on t.doc_id = d.doc_id
left join classes c on c.node = t.node left join comps p on p.a = c.doc_id"""

#: kind, expression, group that is measured, least length. Quotes are doubled for SQL.
SECRETS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("google_api", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("bearer", r"(?i:authorization:\x20*bearer)\x20+([A-Za-z0-9._~+/-]{16,}=*)", 1, 16),
]


def _secrets() -> str:
    each = []
    for o, (kind, expression, group, least) in enumerate(SECRETS):
        hits, gaps = f"regexp_extract_all(t, '{expression}', 0)", f"regexp_split_to_array(t, '{expression}')"
        begin = "coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:k-1], lambda x: length(x))), 0)"
        each.append(f"""select doc_id, {o} as o, '{kind}' as kind, cast(b as bigint) as b, cast(b + length(h[k]) as bigint) as e from (
            select doc_id, h, k, length(v[k]) as size, {begin} as b from (select doc_id, h, g, v, unnest(range(1, len(h) + 1)) as k from (
            select doc_id, {hits} as h, {gaps} as g, regexp_extract_all(t, '{expression}', {group}) as v from docs))) where size >= {least}""")
    joined = "string_agg(kind || ':' || b || ':' || e, ',' order by b, o, e)"
    return f"""with docs as (select doc_id, coalesce(text, '') as t from documents), spans as ({" union all ".join(each)})
        select d.doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
        sha256(coalesce({joined} filter (o < 3), '')) as base_sha256, coalesce({joined}, '') as spans
        from docs d left join spans s on s.doc_id = d.doc_id group by d.doc_id"""


#: Vectors whose components are all there and finite; those components times 256, rounded down.
USABLE = "embedding is not null and not coalesce(list_bool_or(list_transform(embedding, lambda x: x is null or isnan(x) or isinf(x))), false)"
WHOLE = "list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint))"


def _clusters(dims: int = 64, clusters: int = 40, rounds: int = 5) -> str:
    """One assignment and one set of centroids after the other; integer division rounds towards zero, so the rest is taken off first."""
    distance = "list_sum(list_transform(list_zip(v.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    assigned = lambda k: f"a{k} as materialized (select v.vec_id, v.v, min((cast({distance} as bigint), c.k)) as best from vs v cross join c{k} c group by v.n, v.vec_id, v.v)"
    floor = "list(cast((s - ((s % n) + n) % n) // n as bigint) order by i)"
    sums = lambda k: f"select k, i, sum(x) as s, count(*) as n from (select best[2] as k, unnest(v) as x, unnest(range(1, {dims + 1})) as i from a{k}) group by k, i"
    moved = lambda k: f"c{k + 1} as materialized (select c.k, coalesce(m.c, c.c) as c from c{k} c left join (select k, {floor} as c from ({sums(k)}) group by k) m on m.k = c.k)"
    start = f"c0 as materialized (select row_number() over (order by sha256('2:' || vec_id), v) - 1 as k, v as c from vs order by k limit {clusters})"
    steps = ", ".join(f"{assigned(k)}, {moved(k)}" for k in range(rounds))
    return f"""with vs as materialized (select row_number() over () as n, vec_id, {WHOLE} as v from embeddings where len(embedding) = {dims} and {USABLE}),
        {start}, {steps}, {assigned(rounds)},
        told as (select vec_id, best[1] as distance, cast(best[2] as integer) as cluster from a{rounds})
        select t.vec_id, t.cluster, t.distance, cast(sum(t.distance) over (partition by t.cluster) as bigint) as cluster_inertia,
        cast(sum(t.distance) over () as bigint) as inertia, sha256(array_to_string(c.c, ',')) as centroid_sha256 from told t join c{rounds} c on c.k = t.cluster"""


OP12 = f"""with vs as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, {WHOLE} as v
    from embeddings where label is not null and {USABLE}),
pairs as materialized (select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, cast(list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2])) as bigint) as score
    from vs a join vs r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id and len(a.v) = len(r.v)),
positives as (select anchor_id, vec_id as positive_id, score as positive_score from pairs where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id) as integer) as rank,
    n.vec_id as negative_id, p.positive_score, n.score as negative_score
from positives p join pairs n on n.anchor_id = p.anchor_id and not n.same and 80 * p.positive_score <= 100 * n.score and n.score <= p.positive_score
qualify rank <= 5"""

OP13 = f"""with recursive vs as (select vec_id, label, cast(embedding as double[]) as v from embeddings where label is not null and {USABLE} and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links as materialized (select a.vec_id as x, b.vec_id as y from vs a join vs b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.93),
reach(x, y) as (select vec_id, vec_id from embeddings union select r.x, l.y from reach r join links l on l.x = r.y),
least as (select x, min(y) as component_id from reach group by x),
degree as (select x, count(*) as n from links group by x)
select e.vec_id, coalesce(d.n, 0) as n_links, l.component_id, e.vec_id = l.component_id as kept
from embeddings e join least l on l.x = e.vec_id left join degree d on d.x = e.vec_id"""

ORACLES = {"op1_url_filters": OP1, "op2_minhash_near_dedup": OP2, "op3_secret_scans": _secrets(), "op11_centroid_clustering": _clusters(), "op12_hard_negatives": OP12, "op13_vector_near_dedup": OP13}
