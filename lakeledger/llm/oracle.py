"""SQL for the queries of the corpus operators that SQL can express.

Token ids, fingerprints, suffix sorting and digests of streams are not among them; tests hold those queries against
brute-force versions.
"""

from __future__ import annotations

from .quality import CLASSES, COMMON_WORDS
from .queries import MIXTURE_EPOCHS, MIXTURE_SEED, MIXTURE_SHARE, MIXTURE_WEIGHTS, URL_RULES

_BLANK = r"[\x20\x09-\x0D]"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return ", ".join(map(_text, values))


# --- URL filters: reachability over the edges by a recursive query ---------------------------------------------

_RULES = ", ".join(f"({_text(h)}, {_text(p)}, {_text(v)})" for h, p, v in URL_RULES)


def _host(url: str) -> str:
    return f"coalesce(translate(regexp_extract({url}, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"


def _node(url: str) -> str:
    rest = f"regexp_extract({url}, '^.*?://[^/?#]*([^#]*)', 1, 's')"
    return f"""case when contains({url}, '://') then lower(regexp_extract({url}, '^(.*?)://', 1, 's')) || '://' || {_host(url)} ||
 case when starts_with({rest}, '/') then {rest} else '/' || {rest} end else '' end"""


def _attribute(tag: str, name: str) -> str:
    return f"""regexp_extract({tag}, '\\b{name}\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'is')"""


_LINK = """case when contains(link, '://') then link
 when starts_with(link, '//') then regexp_extract(url, '^(.*?:)//', 1, 's') || link
 when starts_with(link, '/') then regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || link
 else regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') ||
  coalesce(nullif(regexp_extract(url, '^.*?://[^/?#]*(/[^?#]*/|/)', 1, 's'), ''), '/') || link end"""

URL_FILTERS = f"""
with recursive rules(rule_host, rule_path, verdict) as (values {_RULES}),
tags as (
 select url, unnest(regexp_extract_all(html, '<(?:link|meta)\\b[^>]*>', 0, 'is')) as tag from pages where html is not null),
links as (
 select url, {_attribute("tag", "href")} as link, row_number() over () as n from tags
  where regexp_matches(tag, '^<link', 'i') and regexp_matches(tag, '\\brel\\s*=\\s*["'']?canonical\\b', 'i')
 union all
 select url, regexp_extract(tag, 'content\\s*=\\s*["''][^"''>]*?url\\s*=\\s*([^"''\\s>]+)', 1, 'is'), 0 from tags
  where regexp_matches(tag, '^<meta', 'i') and regexp_matches(tag, '\\bhttp-equiv\\s*=\\s*["'']?refresh\\b', 'i')),
ends as (select url, {_LINK} as target from (select url, replace(link, '&amp;', '&') as link from links where link <> '')),
edges as (select {_node("url")} as a, {_node("target")} as b from ends),
both_ways as (select a, b from edges where a <> b and a <> '' and b <> '' union select b, a from edges where a <> b and a <> '' and b <> ''),
reach(node, other) as (select a, b from both_ways union select r.node, e.b from reach r join both_ways e on r.other = e.a),
judged as (
 select u, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(verdict, length(rule_host || rule_path)) as verdict
 from (select distinct other as u from reach union select url from pages where url is not null) n join rules
  on ({_host("u")} = rule_host or ends_with({_host("u")}, '.' || rule_host)) and starts_with({_path("u")}, rule_path)
 group by u),
blocked as (select distinct node from reach join judged on other = u and verdict = 'block')
select page_id, {_host("url")} as host, {_path("url")} as path, rule,
 coalesce(verdict, case when {_node("url")} in (select node from blocked) then 'block' else 'allow' end) as verdict
from pages left join judged on url = u"""


# --- quality rules ----------------------------------------------------------------------------------------------

_LEFT = ",\n".join(
    f"left{k} as (select *, regexp_replace(t{k}, {_text(pattern)}, '', 'g') as t{k + 1} from {'texts' if k == 0 else f'left{k - 1}'})"
    for k, (_, pattern) in enumerate(CLASSES)
)
_N = len(CLASSES)
_COUNTS = ", ".join([*(f"length(t{k}) - length(t{k + 1}) as c{k}" for k in range(_N)), f"length(t{_N}) as c{_N}"])


def _half(p: str, q: str) -> str:
    return f"case when {p} > 0 then {p} * log2(2 * {p} / ({p} + {q})) else 0 end"


_TOTAL = " + ".join(f"c{k}" for k in range(_N + 1))
_REF_TOTAL = " + ".join(f"r{k}" for k in range(_N + 1))
_CLASS_TERMS = " + ".join(
    f"({_half(f'(c{k} / ({_TOTAL}))', f'(r{k} / ({_REF_TOTAL}))')} + {_half(f'(r{k} / ({_REF_TOTAL}))', f'(c{k} / ({_TOTAL}))')}) / 2"
    for k in range(_N + 1)
)

QUALITY_RULES = f"""
with texts as (
 select doc_id, row_number() over () as n, coalesce(lang, '') as lang, coalesce(text, '') as t0,
  list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}+'), lambda w: w <> '') as words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
 from documents),
{_LEFT},
counted as (
 select doc_id, n, lang, words, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
  length(t4) - length(regexp_replace(t4, '[#*$%&|<>]', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
  {_COUNTS}
 from left{_N - 1}),
windows as (
 select n, i, array_to_string(words[i : i + 4], ' ') as w from (select n, words, unnest(range(1, len(words) - 3)) as i from counted)),
often as (select n, i from windows qualify count(*) over (partition by n, w) > 1),
repeated as (select n, count(distinct i + k) as n_repeat_words from often cross join range(5) as t(k) group by n),
named as (
 select n, lang, word, count(*) as m from (select n, lang, unnest(words) as word from counted)
 where word in ({_list(COMMON_WORDS)}) group by all),
sums as (select lang, sum(n_words) as total, {", ".join(f"sum(c{k}) as r{k}" for k in range(_N + 1))} from counted group by lang),
shares as (select lang, word, sum(m) as r from named group by all),
named_share as (select lang, sum(r) as named from shares group by lang),
bins as (
 select c.n, c.n_words, total, r / total as q, coalesce(m, 0) / c.n_words as p
 from counted c join sums using (lang) join shares using (lang) left join named d on d.n = c.n and d.word = shares.word where c.n_words > 0),
by_word as (select n, sum(({_half("p", "q")} + {_half("q", "p")}) / 2) as d, sum(p) as p, sum(q) as q from bins group by n),
judged as (
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  case when {_TOTAL} - c1 >= 200 then sqrt(greatest(0, {_CLASS_TERMS})) else 0 end as by_class,
  case when n_words >= 50 then sqrt(greatest(0, coalesce(d, 0) +
   ({_half("(1 - coalesce(p, 0))", "(1 - coalesce(q, 0))")} + {_half("(1 - coalesce(q, 0))", "(1 - coalesce(p, 0))")}) / 2)) else 0 end as by_words,
  sqrt(greatest(0, (coalesce(q, 0) + {_half("1e0", "(1 - coalesce(q, 0))")} + {_half("(1 - coalesce(q, 0))", "1e0")}) / 2)) as bare
 from counted join sums using (lang) left join repeated using (n) left join by_word using (n))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
 n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
 not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and by_class <= 0.25 and by_words <= 0.45
  and (bare <= 0 or by_words <= bare * case when n_words < 120 then 0.98e0 else 0.85e0 end) as kept
from judged"""


# --- mixture: the levels one after another, shortages by the level that fills -----------------------------------

_WEIGHTS = ", ".join(f"({_text(a)}, {_text(b)}, {w}e0)" for a, b, w in MIXTURE_WEIGHTS)


def _level(k: int, level: str, above: str) -> str:
    """Budgets of the nodes of one level from those above: the highest fill level that the budget allows."""
    return f"""
nodes{k} as (
 select p{k} as parent, p{k + 1} as node, cast(sum(tokens) * {MIXTURE_EPOCHS} as double) as cap from leaves group by all),
weighed{k} as (
 select n.*, coalesce(weight, 1e0) as weight, budget from nodes{k} n join {above} b on n.parent = b.node
 left join weights w on w.level = '{level}' and w.key = n.node),
levels{k} as (
 select parent, cap / weight as ratio, node, (budget - coalesce(sum(cap) over before, 0)) /
  (sum(weight) over (partition by parent) - coalesce(sum(weight) over before, 0)) as fill, weight, cap
 from weighed{k} window before as (partition by parent order by cap / weight, node rows between unbounded preceding and 1 preceding)),
filled{k} as (select parent, arg_min(fill, (ratio, node)) as fill from levels{k} where fill * weight <= cap group by parent),
budgets{k} as (
 select node, cast(floor(case when fill is null then cap else least(cap, floor(fill * weight)) end) as bigint) as budget
 from weighed{k} left join filled{k} using (parent))"""


SOURCE_MIXING = f"""
with weights(level, key, weight) as (values {_WEIGHTS}),
docs as (
 select doc_id, lang, source, domain, n_tokens, concat_ws('/', domain, coalesce(lang, ''), coalesce(source, '')) as leaf from (
  select doc_id, lang, source, cast(ceil(coalesce(strlen(text), 0) / 4) as bigint) as n_tokens,
   case when source = 'src0' then 'crawl'
    when regexp_matches(source, '^src[0-9]+$') and cast(substr(source, 4) as int) % 2 = 1 then 'web' else 'reference' end as domain
  from documents)),
leaves as (
 select '' as p0, domain as p1, domain || '/' || coalesce(lang, '') as p2, leaf as p3, sum(n_tokens) as tokens from docs group by all),
whole as (select '' as node, least(sum(tokens) * {MIXTURE_EPOCHS}, cast(floor(sum(tokens) * {MIXTURE_SHARE}e0) as bigint)) as budget from leaves),
{_level(0, "domain", "whole")},
{_level(1, "lang", "budgets0")},
{_level(2, "source", "budgets1")},
plan as (
 select p3 as leaf, case when tokens > 0 then budget // tokens else 0 end as epochs, tokens, budget
 from leaves join budgets2 on p3 = node),
copies as (
 select d.*, e.epoch, plan.tokens, plan.budget, md5('{MIXTURE_SEED}:' || e.epoch || ':' || d.doc_id) as mark
 from docs d join plan using (leaf) join range({MIXTURE_EPOCHS} + 1) as e(epoch) on e.epoch <= plan.epochs),
placed as (
 select *, epoch * tokens + coalesce(sum(n_tokens) over (partition by leaf, epoch order by mark, n_tokens
  rows between unbounded preceding and 1 preceding), 0) as before from copies)
select doc_id, domain, lang, source, n_tokens, cast(epoch as int) as epoch, cast(least(n_tokens, budget - before) as bigint) as take_tokens
from placed where before < budget"""

# --- manifest: one level of all trees after another --------------------------------------------------------------

#: Levels written out: trees of up to 2 ** 26 rows.
_HEIGHT = 26


def _field(value: str) -> str:
    return f"coalesce(strlen(cast({value} as varchar)) || ':' || cast({value} as varchar), '-')"


def _row_hash(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


#: CRC-32 of a decimal number, bit by bit: each byte is taken in with the first of its eight shifts.
_BITS = "flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda x: [ascii(x), 0, 0, 0, 0, 0, 0, 0]))"
_CRC = f"""xor(list_reduce(list_transform([4294967295] || {_BITS}, lambda x: cast(x as bigint)),
  lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)"""


def _climb(name: str, source: str) -> str:
    """From rows (tree, n, place, node, folded, proof, ...) of ``source`` up to their root: nodes of each level, then the rows' own way."""
    steps = [f"{name}_nodes0 as materialized (select distinct tree, n, place, node from {source})"]
    last = source
    for k in range(_HEIGHT):
        steps.append(
            f"""{name}_nodes{k + 1} as materialized (
 select tree, n, place // 2 as place, case when n > {2**k} then sha256(string_agg(node, '' order by place)) else min(node) end as node,
  min(node) filter (place % 2 = 0) as even, min(node) filter (place % 2 = 1) as odd
 from {name}_nodes{k} group by tree, n, place // 2)"""
        )
        left = f"(s.place // {2**k}) % 2 = 0"
        steps.append(
            f"""{name}{k + 1} as materialized (
 select s.* exclude (proof, folded), case when s.n <= {2**k} then proof when {left} then proof || coalesce(odd, '') else proof || even end as proof,
  case when s.n <= {2**k} then folded when {left} then sha256(folded || coalesce(odd, '')) else sha256(even || folded) end as folded
 from {last} s join {name}_nodes{k + 1} r on r.tree is not distinct from s.tree and r.place = s.place // {2 ** (k + 1)})"""
        )
        last = f"{name}{k + 1}"
    return ",\n".join(steps)


MERKLE_MANIFEST = f"""
with leaves as materialized (
 select doc_id, lang as tree, leaf, leaf as node, case when crc % 7 = 0 then changed else leaf end as folded, '' as proof,
  row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by lang) as n
 from (select *, {_row_hash("n_chars")} as leaf, {_row_hash("n_chars + 1")} as changed, {_CRC} as crc from documents)),
{_climb("leaf", "leaves")},
subroots as materialized (
 select tree as lang, node as subroot, row_number() over (order by tree nulls first) - 1 as place, count(*) over () as n from leaf_nodes{_HEIGHT}),
trees as materialized (
 select doc_id, leaf, folded, proof, subroot, subroot as node, '' as tree, s.place, s.n
 from leaf{_HEIGHT} l join subroots s on l.tree is not distinct from s.lang),
{_climb("tree", "trees")}
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified
from tree{_HEIGHT} cross join (select node as root from tree_nodes{_HEIGHT}) as top"""


# --- windows of words ----------------------------------------------------------------------------------------------

WINDOW_DEDUP = f"""
with docs as materialized (
 select doc_id, row_number() over () as n, list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}+'), lambda w: w <> '') as words
 from documents),
windows as (
 select n, i, array_to_string(words[i : i + 34], ' ') as w from (select n, words, unnest(range(1, len(words) - 33)) as i from docs)),
often as (select n, i from windows qualify count(*) over (partition by w) > 1),
gone as (select distinct n, i + k as i from often cross join range(35) as t(k)),
placed as (select n, unnest(words) as word, generate_subscripts(words, 1) as i from docs),
kept as (select n, string_agg(word, ' ' order by i) as text, count(*) as m from placed anti join gone using (n, i) group by n)
select doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(m, 0) as bigint) as n_removed,
 sha256(coalesce(kept.text, '')) as kept_sha256
from docs left join kept using (n)"""

SQL: dict[str, str] = {
    "op3_url_filters": URL_FILTERS,
    "op7_source_mixing": SOURCE_MIXING,
    "op8_quality_rules": QUALITY_RULES,
    "op11_merkle_manifest": MERKLE_MANIFEST,
    "op13_window_dedup": WINDOW_DEDUP,
}
