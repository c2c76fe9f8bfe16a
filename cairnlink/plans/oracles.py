"""SQL twins of the queries, for DuckDB. Shared parts are common table expressions, written once."""

from __future__ import annotations

from cairnlink.functions import fixed_values as V


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _map(words: dict[str, str]) -> str:
    return "map {" + ", ".join(f"'{k}': '{v}'" for k, v in words.items()) + "}"


def _mapped(word: str, words: dict[str, str]) -> str:
    return f"coalesce(map_extract({_map(words)}, {word})[1], {word})"


def _words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def _found(x: str, least: int = 1) -> str:
    """Words of letters, digits and underscores."""
    out = rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"
    return f"list_filter({out}, lambda w: length(w) >= {least})" if least > 1 else out


def _case(x: str) -> str:
    run = r"\b(?:[a-zA-Z]\s*\.\s*)+[a-zA-Z]\b\.?"
    x = rf"list_reduce(list_prepend({x}, regexp_extract_all({x}, '{run}')), lambda a, r: replace(a, r, regexp_replace(r, '[.\s]+', '', 'g')))"
    x = f"translate(translate(trim(lower({x})), '‘’`´‚', ''''''''''''), '–—−', '---')"
    return rf"regexp_replace(replace({x}, '&', ' and '), '(?i)\b(?:d/?b/?a|doing\s+business\s+as)\b', ' doing business as ', 'g')"


def _url(x: str) -> str:
    return f"regexp_replace({x}, '{V.URL}', ' ', 'g')"


def _strip(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s/\-'']', ' ', 'g'), '\s+', ' ', 'g'))"


def _missing(x: str) -> str:
    plain = f"lower(trim(coalesce({x}, '')))"
    return f"({plain} in ({_list(V.MISSING_ADDRESSES)}) or starts_with({plain}, 'no address') or starts_with({plain}, 'missing'))"


def _name(x: str) -> str:
    clean = _strip(_case(_url(f"case when lower(trim({x})) in ({_list(V.MISSING_NAMES)}) then '' else trim({x}) end")))
    for phrase, form in V.LEGAL_PHRASES:
        clean = rf"regexp_replace({clean}, '(^| ){phrase}$', '\1{form}')"
    return clean


def _legal(words: str) -> str:
    last = f"len({words})"
    spelled = f"case when i <= {last} - 3 then w when w = 'p' and i < {last} and {words}[i + 1] in ('ltd', 'limited') then 'private' else {_mapped('w', V.LEGAL_MAP)} end"
    return f"coalesce(array_to_string(list_transform({words}, lambda w, i: {spelled}), ' '), '')"


def _address(x: str) -> str:
    x = _case(_url(f"case when {_missing(x)} then '' else trim({x}) end"))
    x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_])#+([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    x = rf"regexp_replace({x}, '{V.ORDINAL}', '\1', 'g')"
    for p in V.LANDMARKS:
        x = rf"regexp_replace({x}, '(?i){p}(\s*[,\d]|$)', ' \1', 'g')"
    return f"list_transform({_words(_strip(x))}, lambda w: {_mapped('w', V.ADDRESS_MAP)})"


def _directed(words: str) -> str:
    street = _list(sorted({*V.ADDRESS_MAP, *V.ADDRESS_MAP.values()}))
    near = f"(coalesce(i > 1 and {words}[i - 1] in ({street}), false) or coalesce({words}[i + 1] in ({street}), false))"
    return f"coalesce(array_to_string(list_transform({words}, lambda w, i: case when w in ({_list(V.DIRECTIONS)}) and {near} then {_mapped('w', V.DIRECTIONS)} else w end), ' '), '')"


def _country(x: str) -> str:
    return _mapped(rf"regexp_replace(lower(trim({x})), '\s+', ' ', 'g')", V.COUNTRY_MAP)


FEED = """feed as (select 'S' || (doc_id % 3 + 1) || '-' || doc_id as entity_id, string_split(text, chr(10))[1] as business_name,
    coalesce(string_split(text, chr(10))[2], '') as business_address, lang as country, doc_id from documents)"""
CLEAN = f"""{FEED}, clean as materialized (select *, {_words(_name('business_name'))} as nw, {_address('business_address')} as aw, {_missing('business_address')} as gone from feed),
rec as materialized (select entity_id, entity_id[1:2] as source, doc_id as number, {_country('country')} as country, trim(business_name) as raw_name, trim(business_address) as raw_address,
    {_legal('nw')} as norm_name, case when gone then '' else {_directed('aw')} end as norm_address, gone from clean)"""
TRUTH = """ones as (select text, lang, min(doc_id) as low, max(doc_id) as high from documents where doc_id % 3 = 0 group by text, lang),
truth as (select distinct 'S1-' || unnest([low, high]) as source1_entity_id, 'S' || (b.doc_id % 3 + 1) || '-' || b.doc_id as candidate_entity_id, b.lang as country
    from documents b join ones using (text, lang) where b.doc_id % 3 <> 0)"""
MANIFEST = "manifest as (select 'S1-' || doc_id as source1_entity_id from documents where doc_id % 3 = 0)"
SHAPE = "case when norm_address <> '' then norm_address else raw_address end"
POSTAL = r"""case when gone then '' when country = 'france' then coalesce(list_last(regexp_extract_all(raw_address, '\b(\d{5})(?:-\d{4})?\b', 1)), '')
    else coalesce(regexp_extract(list_last(regexp_extract_all(raw_address, '\b(?:[1-9]\d{5}|\d{5}(?:-\d{4})?)\b')), '^(\d+)', 1), '') end"""
KEYS = rf"""{CLEAN}, toks as materialized (select *, {_words('norm_name')} as t, {POSTAL} as postal,
    case when gone then '' else regexp_extract(regexp_replace({SHAPE}, '(^|[^\p{{L}}\p{{N}}_])#+([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '{V.STREET_NUMBER}', 1) end as street,
    case when gone then '' else trim(regexp_extract(regexp_replace({SHAPE}, '(^|[^\p{{L}}\p{{N}}_])#+([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '{V.TRAILING_SEGMENT}', 1)) end as trail from rec),
cont as materialized (select *, case when len(list_filter(t, lambda w: w not in ({_list(V.NAME_STOPWORDS)}))) > 0 then list_filter(t, lambda w: w not in ({_list(V.NAME_STOPWORDS)})) else t end as c from toks),
lead as materialized (select *, coalesce(c[1], '') as lead, case when len(c) >= 2 then c[1] || ' ' || c[2] when len(t) >= 2 then t[1] || ' ' || t[2] end as two,
    case when len(t) >= 2 then array_to_string(list_sort(list_distinct(t)), ' ') end as srt, case when len(t) >= 2 then t[1][1:1] || t[2][1:1] end as acr from cont),
keys as materialized (
    select entity_id, country, source, number, 0 as bit, norm_name as key, 1.0 as score from lead where norm_name <> ''
    union all select entity_id, country, source, number, 1, srt, 0.98 from lead where srt is not null
    union all select entity_id, country, source, number, 2, two, 0.90 from lead where two is not null
    union all select entity_id, country, source, number, 3, norm_name || chr(1) || postal, 1.0 from lead where norm_name <> '' and postal <> ''
    union all select entity_id, country, source, number, 4, norm_name || chr(1) || street, 0.95 from lead where norm_name <> '' and street <> ''
    union all select entity_id, country, source, number, 5, norm_name || chr(1) || trail, 0.95 from lead where norm_name <> '' and trail <> ''
    union all select entity_id, country, source, number, 6, lead || chr(1) || postal, 0.90 from lead where length(lead) >= 3 and postal <> ''
    union all select entity_id, country, source, number, 7, lead || chr(1) || street || chr(1) || trail, 0.90 from lead where length(lead) >= 3 and street <> '' and trail <> ''
    union all select entity_id, country, source, number, 8, postal || chr(1) || street, 0.85 from lead where not gone and postal <> '' and street <> ''
    union all select entity_id, country, source, number, 12, acr, 0.75 from lead where acr is not null),
posting as (select *, row_number() over (partition by country, bit, key order by source, number, entity_id) as rank from keys where source <> 'S1'),
hits as materialized (select a.entity_id as s1, b.entity_id as cand, a.bit, cast(a.score as double) as score, cast(b.rank as integer) as rank from keys a join posting b on a.country = b.country and a.bit = b.bit and a.key = b.key
    where a.source = 'S1' and b.rank <= case when a.bit = 12 then 10 else 50 end),
united as materialized (select s1, cand, max(score) as score, min(rank) as rank, cast(bit_or(1 << bit) as integer) as mask from hits group by all)"""
PLACED = f"""{KEYS}, placed as materialized (select *, cast(row_number() over (partition by s1 order by (mask & 255) <> 0 desc, bit_count(mask) desc, score desc, rank, cand) as integer) as place from united qualify place <= 10),
named as materialized (select *, {" || ".join(f"case when mask & {1 << i} <> 0 then ',{name}' else '' end" for i, (name, _) in enumerate(V.CHANNELS))} as names from placed)"""
SCORED = """scored as materialized (select distinct 'S1-' || o_custkey as source1_entity_id, 'S2-' || l_partkey as candidate_entity_id, ((o_custkey * 7919 + l_partkey * 104729) % 10007) / cast(10007.0 as double) as calibrated_score
    from lineitem join orders on l_orderkey = o_orderkey),
marked as (select source1_entity_id, candidate_entity_id from scored where calibrated_score * cast(10007 as double) % 3 < 1),
claimed as materialized (select * from scored qualify row_number() over (partition by candidate_entity_id order by calibrated_score desc, source1_entity_id) = 1)"""
LABELLED = """labelled as (select doc_id, lang, quality, quality as label, round(length(regexp_replace(text, '[^a-z]', '', 'g')) / greatest(length(text), 1), 4) as score from documents join labels using (doc_id))"""
SIMS = """vecs as (select vec_id as id, embedding as v, label from embeddings), asked as (select * from vecs where id % 5 = 0),
sims as materialized (select q.id as q, c.id as c, round(list_sum(list_transform(list_zip(q.v, c.v), lambda p: cast(p[1] as double) * p[2])), 6) as sim, q.label = c.label and q.id // 20 = c.id // 20 as rel from asked q join vecs c on q.id <> c.id)"""
HALF = "case when p = 0 and a = 0 then 1.0 when r = 0 or p = 0 or a = 0 then 0.0 else 1.25 * (r / p) * (r / a) / (0.25 * (r / p) + r / a) end"
PAIRS = """pairs as (select l.p_partkey as lk, r.p_partkey as rk, l.p_name as ln, r.p_name as rn, l.p_type || ' ' || l.p_size as la, r.p_type || ' ' || r.p_size as ra
    from part l join part r on l.p_brand = r.p_brand and l.p_size = r.p_size and l.p_partkey < r.p_partkey)"""


def _grams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) + 3), lambda i: substring('  ' || {x} || '  ', i, 3)))"


def _jaccard(a: str, b: str) -> str:
    return f"(case when len({a}) = 0 and len({b}) = 0 then 1.0 when len({a}) = 0 or len({b}) = 0 then 0.0 else len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) end)"


def _overlap(a: str, b: str) -> str:
    return f"(case when len({a}) = 0 and len({b}) = 0 then 1.0 when len({a}) = 0 or len({b}) = 0 then 0.0 else len(list_intersect({a}, {b})) / least(len(list_distinct({a})), len(list_distinct({b}))) end)"


def _ascii(x: str) -> str:
    """DuckDB's levenshtein counts bytes: accented letters become capitals, which no normalised text has."""
    return f"translate({x}, 'áàâäåçéèêëíîïñóòôöúùûüœæß–', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


def _edit(a: str, b: str) -> str:
    return f"round(case when {a} = {b} then 1.0 when {a} = '' or {b} = '' then 0.0 else 1.0 - levenshtein({_ascii(a)}, {_ascii(b)}) / greatest(length({a}), length({b})) end, 6)"


MATCHED = f"""{KEYS}, placed as (select * from united qualify row_number() over (partition by s1 order by (mask & 255) <> 0 desc, bit_count(mask) desc, score desc, rank, cand) <= 10), {MANIFEST},
sc as (select s1, cand, round(0.6 * {_jaccard(_found('l.norm_name'), _found('r.norm_name'))} + 0.4 * {_jaccard(_found('l.norm_address'), _found('r.norm_address'))}, 6) as score from placed join rec l on l.entity_id = s1 join rec r on r.entity_id = cand),
cl as (select * from sc where score >= 0.5 qualify row_number() over (partition by cand order by score desc, s1) = 1),
matched as materialized (select source1_entity_id, coalesce(string_agg(cand, ',' order by score desc, cand), '') as matched_entity_ids from manifest left join cl on s1 = source1_entity_id group by 1)"""


def _channel(name: str, ones: str, terms: str, length: str, df: int, keep: int, floor: float, raw: int) -> str:
    """Tables of one term channel; the last, ``name``, has s1, cand, score and rank."""
    return f"""{name}_src as materialized (select entity_id, source, country, {terms} as terms, {length} as len from lead),
    {name}_cand as materialized (select entity_id, country, len, unnest(list_distinct(terms)) as term from {name}_src where source <> 'S1'),
    {name}_n as (select count(*) as n from {name}_src where source <> 'S1'),
    {name}_idf as materialized (select country, term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) as idf from {name}_cand, {name}_n group by country, term, n having count(*) <= {df}),
    {name}_one as (select entity_id, country, unnest(terms) as term from {name}_src where source = 'S1' and {ones}),
    {name}_w as (select entity_id, country, term, round((1 + ln(count(*))) * any_value(idf), 9) as w from {name}_one join {name}_idf using (country, term) group by entity_id, country, term),
    {name}_kept as materialized (select *, sqrt(sum(w * w) over (partition by entity_id)) as norm from (select * from {name}_w qualify row_number() over (partition by entity_id order by w desc, term) <= {keep})),
    {name}_raw as (select k.entity_id as s1, c.entity_id as cand, round(sum(w), 6) as raw, any_value(norm) as norm, any_value(len) as len from {name}_kept k join {name}_cand c using (country, term) group by all),
    {name}_top as (select * from {name}_raw qualify row_number() over (partition by s1 order by raw desc, cand) <= {raw}),
    {name}_sc as (select s1, cand, round(least(1.0, raw / (norm * sqrt(len))), 6) as score from {name}_top),
    {name} as materialized (select s1, cand, score, cast(row_number() over (partition by s1 order by score desc, cand) as integer) as rank from {name}_sc where score >= {floor} qualify rank <= 50)"""


def _terms(*channel) -> str:
    return f"with {KEYS}, {_channel('best', 'true', *channel)} select s1, cand, round(score + 1e-9, 4) as score from best"


PAIRED = f"""{PLACED}, per as (select s1, count(*) as cnt, max(round(score, 4)) as most from placed group by s1),
pf as materialized (select n.s1, n.cand, n.names[2:] as prov, bit_count(n.mask)::int as bc, n.rank as rk, round(n.score, 4) as sc, per.cnt, per.most, l.norm_name as ln, r.norm_name as rn, l.norm_address as la, r.norm_address as ra,
    case when l.gone then '' else l.postal end as lp, case when r.gone then '' else r.postal end as rp, trim(fl.country) as lc, trim(fr.country) as rc, l.country as lcc, r.country as rcc
    from named n join per using (s1) join lead l on l.entity_id = n.s1 join lead r on r.entity_id = n.cand join feed fl on fl.entity_id = n.s1 join feed fr on fr.entity_id = n.cand)"""
_FULL = "ln <> '' and rn <> '' and la <> '' and ra <> ''"
FLAGS = f"""(cand[1:2] = 'S3')::int as source_is_s3, case when lcc = '' or rcc = '' then -1 else (lcc = rcc)::int end as country_equal, (ln = rn and ln <> '')::int as name_exact, (la = ra and la <> '')::int as address_exact,
    abs(length(ln) - length(rn))::int as name_length_abs_diff, abs(length(la) - length(ra))::int as address_length_abs_diff, ({_FULL} and ln = rn and la <> ra)::int as same_name_different_address,
    ({_FULL} and la = ra and ln <> rn)::int as same_address_different_name, rk as candidate_rank, greatest(0, rk - 1)::int as rank_margin_from_best, bc as blocker_count, cnt::int as candidate_count_for_s1"""


def _set_measure(measure, a: str, b: str, found=None) -> str:
    found = found or _found
    return f"round(case when {a} = {b} then 1.0 else {measure(found(a), found(b))} end, 6)"


def _digits(x: str) -> str:
    return f"regexp_extract_all({x}, '[0-9]+')"


NAME_TERMS = "list_filter(t, lambda w: length(w) >= 3)"
ADDRESS_TERMS = f"case when gone or norm_address = '' then [] else list_filter(regexp_extract_all(norm_address, '[a-z0-9]+'), lambda w: length(w) >= 3 and w not in ({_list(V.ADDRESS_STOPWORDS)})) end"
GRAM_TERMS = "list_concat(list_transform(range(1, greatest(length(norm_name) - 1, 1)), lambda i: substring(norm_name, i, 3)), list_transform(range(1, greatest(length(norm_name) - 2, 1)), lambda i: substring(norm_name, i, 4)))"
TOKENS = (NAME_TERMS, "greatest(1, len(t))", 2500, 10, 0.30, 150)
ADDRESSES = (ADDRESS_TERMS, f"greatest(1, len({ADDRESS_TERMS}))", 5000, 10, 0.20, 50)
GRAMS = (GRAM_TERMS, f"greatest(1, len({GRAM_TERMS}))", 5000, 15, 0.30, 150)
_UNITE = "select s1, cand, max(score) as score, min(rank) as rank, cast(bit_or(mask) as integer) as mask from"
GENERATED = f"""{KEYS}, {_channel("addr", "true", *ADDRESSES)},
first as materialized ({_UNITE} (select s1, cand, score, rank, mask from united union all select s1, cand, score, rank, 1 << 9 from addr) group by all),
settled as materialized (select s1 from first group by s1 having (max(mask & 255) > 0 and count(*) >= 8) or count(*) >= 50),
{_channel("tok", "entity_id not in (select s1 from settled)", *TOKENS)},
second as materialized ({_UNITE} (select * from first union all select s1, cand, score, rank, 1 << 10 from tok) group by all),
{_channel("gram", "entity_id not in (select s1 from settled) and entity_id not in (select s1 from second group by s1 having count(*) >= 8)", *GRAMS)},
third as ({_UNITE} (select * from second union all select s1, cand, score, rank, 1 << 11 from gram) group by all),
found as materialized (select *, cast(row_number() over (partition by s1 order by (mask & 255) <> 0 desc, bit_count(mask) desc, score desc, rank, cand) as integer) as place from third qualify place <= 50)"""
NAMES = " || ".join(f"case when mask & {1 << i} <> 0 then ',{name}' else '' end" for i, (name, _) in enumerate(V.CHANNELS))
AUDIT = "cast(sum(n) as bigint) as pairs, round(sum(hit) / sum(n), 6) as pair_recall, count(*) as entities, round(avg((n = hit)::int), 6) as full_recall, round(avg((hit > 0)::int), 6) as any_hit"
PER = "per as (select t.source1_entity_id, t.country, count(*) as n, count(p.s1) as hit from truth t left join placed p on p.s1 = t.source1_entity_id and p.cand = t.candidate_entity_id group by all)"

TRAINING = f"""with {PLACED}, {TRUTH}, e as (select entity_id, case when norm_name <> '' and norm_address <> '' then norm_name || ' | ' || norm_address when norm_name <> '' and gone then norm_name || ' | [NO_ADDRESS]' when norm_name <> '' then norm_name when norm_address <> '' then norm_address else '[NO_ADDRESS]' end as text from rec),
        n as (select s1, cand, place, r.text from placed join e l on l.entity_id = s1 join e r on r.entity_id = cand where r.text <> '' and r.text <> l.text
            and not exists (select 1 from truth t where t.source1_entity_id = s1 and t.candidate_entity_id = cand) and not exists (select 1 from truth t join e g on g.entity_id = t.candidate_entity_id where t.source1_entity_id = s1 and g.text = r.text)),
        k as (select * from n qualify row_number() over (partition by s1 order by place, cand) <= 5), neg as (select s1, list(text order by place, cand) as negatives from k group by s1),
training as (select t.source1_entity_id as s1_id, t.candidate_entity_id as matched_id, a.text as anchor, b.text as positive, coalesce(negatives, []) as negatives from truth t join e a on a.entity_id = t.source1_entity_id join e b on b.entity_id = t.candidate_entity_id left join neg on s1 = t.source1_entity_id)"""

ORACLES = {
    "norm_country": f"with x as (select lower(n_name) as country from nation union all select distinct lang from documents) select country, {_country('country')} as canonical from x",
    "country_flags": f"with {FEED} select entity_id, cast({_country('country')} = 'france' as integer) as with_france, cast(null as integer) as with_none, regexp_extract(entity_id, '^(S[123])-', 1) as source from feed",
    "norm_case_typography": f"with x as (select p_partkey, p_name || ' & Co – ' || p_brand || '’s' as a from part) select p_partkey, {_case('a')} as clean from x",
    "norm_legal_suffix": f"""with x as (select p_partkey, p_name || ' ' || ['Pvt Ltd', 'Inc.', 'P. Ltd.', 'Corp', 'Svcs Co', 'LLC', 'societe anonyme', 'Assoc Intl Grp'][p_partkey % 8 + 1] as a from part),
        y as (select p_partkey, {_words(_name('a'))} as nw from x) select p_partkey, {_legal('nw')} as norm_name from y""",
    "norm_address_expand": f"""with x as (select p_partkey, p_partkey || ' ' || ['N Main St', 'Block A', 'S Park Ave, Apt 4', '22nd Cross Rd', '##8 Oak Ln', 'W 5th Blvd'][p_partkey % 6 + 1] || ', near SBI Bank, ' || p_type as a from part),
        y as (select p_partkey, {_address('a')} as aw from x) select p_partkey, {_directed('aw')} as norm_address from y""",
    "normalized_records": f"""with {CLEAN} select entity_id, source, country as country_canonical, norm_name, norm_address,
        case when norm_name <> '' and norm_address <> '' then norm_name || ' | ' || norm_address when norm_name <> '' and gone then norm_name || ' | [NO_ADDRESS]' when norm_name <> '' then norm_name when norm_address <> '' then norm_address else '[NO_ADDRESS]' end as encoder_text,
        gone::int as is_address_missing, len({_words('norm_name')})::int as name_token_count, len({_words('norm_address')})::int as address_token_count from rec""",
    "missing_address": f"with {FEED} select entity_id, {_missing('business_address')} as missing from feed",
    "postal_code": r"""with x as (select o_orderkey, (o_orderkey * 37 % 90000 + 10000) || ' Main St, Town ' || (o_custkey * 9973 % 990000 + 10000) as a from orders), z as (select *, regexp_extract_all(a, '\b(\d{5})(?:-\d{4})?\b', 1) as zips from x)
        select o_orderkey, case when len(zips) > 1 then list_last(zips) end as us, list_last(regexp_extract_all(a, '\b([1-9][0-9]{5})\b', 1)) as india, list_last(zips) as france,
            regexp_extract(list_last(regexp_extract_all(a, '\b(?:[1-9]\d{5}|\d{5}(?:-\d{4})?)\b')), '^(\d+)', 1) as any from z""",
    "structural_fields": r"""with x as (select o_orderkey, o_custkey || ' Lake Town, Block ' || o_orderkey || ', ' || o_orderpriority as a from orders)
        select o_orderkey, coalesce(array_to_string(regexp_extract_all(a, '\b\d{4,10}(?:-\d{3,4})?\b'), '|'), '') as runs, trim(regexp_extract(a, ',\s*([^,]+)$', 1)) as trailing, regexp_extract(a, '^\s*(\d{1,6})\b', 1) as street from x""",
    "name_keys": f"""with x as (select p_partkey, {_words('p_name')} as t from part), y as (select *, case when len(list_filter(t, lambda w: w not in ({_list(V.NAME_STOPWORDS)}))) > 0 then list_filter(t, lambda w: w not in ({_list(V.NAME_STOPWORDS)})) else t end as c from x)
        select p_partkey, case when len(c) >= 2 then c[1] || ' ' || c[2] when len(t) >= 2 then t[1] || ' ' || t[2] end as two, case when len(t) >= 2 then array_to_string(list_sort(list_distinct(t)), ' ') end as sorted, coalesce(c[1], '') as lead, case when len(t) >= 2 then t[1][1:1] || t[2][1:1] end as acronym from y""",
    "char_ngrams": """with x as (select p_partkey, unnest(list_concat(list_transform(range(1, greatest(length(p_name) - 1, 1)), lambda i: substring(p_name, i, 3)), list_transform(range(1, greatest(length(p_name) - 2, 1)), lambda i: substring(p_name, i, 4)))) as gram from part)
        select gram, count(*) as n, count(distinct p_partkey) as parts from x group by gram""",
    "token_sets": f"""with y as (select p_partkey, p_brand || ' ' || p_type as x from part) select p_partkey, len({_found('x')})::int as n_words, len(list_filter(regexp_extract_all(x, '[a-z0-9]+'), lambda w: length(w) >= 3))::int as n_ascii,
        len({_grams('x')})::int as n_trigrams, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(x, '\\d+'))), '|'), '') as numbers from y""",
    "multi_acronyms": f"""with {KEYS}, w as (select entity_id, c, regexp_extract_all(raw_name, '[\\p{{L}}\\p{{N}}_]+') as r from lead),
        a as (select entity_id, list_concat(case when len(c) >= 2 then [c[1][1:1] || c[2][1:1]] else [] end, case when len(c) between 2 and 6 then [array_to_string(list_transform(c, lambda x: x[1:1]), '')] else [] end,
            list_transform(list_filter(r, lambda x: (regexp_full_match(x, '\\p{{Lu}}{{2,5}}') or lower(x) in ({_list(V.KNOWN_ACRONYMS)})) and lower(x) not in ({_list(sorted({*V.ACRONYM_SKIP, *V.LEGAL_MAP, *V.LEGAL_MAP.values()}))})), lambda x: lower(x))) as l from w)
        select entity_id, coalesce(array_to_string(list_sort(list_distinct(l)), ','), '') as acronyms from a""",
    "dense_feature": """with v as (select vec_id, case when vec_id % 10 <> 9 then list_transform(embedding, lambda x: cast(x as double)) end as v from embeddings)
        select a.vec_id::varchar as source1_entity_id, (a.vec_id + 1)::varchar as candidate_entity_id, coalesce(round(list_cosine_similarity(a.v, b.v), 4), 0.0) as bge_cosine, (a.v is null or b.v is null)::int as bge_cosine_missing from v a left join v b on b.vec_id = a.vec_id + 1""",
    "candidate_list_scan": f"with {PLACED} select s1 as source1_entity_id, (place - 1)::int as position, cand as candidate_entity_id from placed where place <= 3",
    "key_channel_hits": f"with {KEYS} select * from hits",
    "posting_cap": "select p_name, p_partkey, cast(row_number() over (partition by p_name order by p_partkey) as integer) as rank from part qualify rank <= 10",
    "doc_freq": f"with {KEYS} select country, term, count(*) as df from (select country, unnest(list_distinct({NAME_TERMS})) as term from lead where source <> 'S1') group by all",
    "idf_table": f"""with {KEYS}, d as (select country, term, count(*) as df from (select country, unnest(list_distinct({NAME_TERMS})) as term from lead where source <> 'S1') group by all), n as (select count(*) as n from lead where source <> 'S1')
        select country, term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf from d, n where df <= 2500""",
    "tfidf_token_topk": _terms(*TOKENS),
    "tfidf_addr_topk": _terms(*ADDRESSES),
    "tfidf_ngram_topk": _terms(*GRAMS),
    "candidate_hits": f"""with {GENERATED} select s1 as source1_entity_id, cand as candidate_entity_id, cand[1:2] as candidate_source, ({NAMES})[2:] as blocker_provenance, bit_count(mask)::int as blocker_count, rank as best_blocker_rank,
        round(score, 4) as best_blocker_score, r.country as country_partition, place from found join rec r on r.entity_id = s1""",
    "linkage_pipeline": f"""with {GENERATED}, {MANIFEST}, x as (select s1, cand, l.norm_name as ln, r.norm_name as rn, l.norm_address as la, r.norm_address as ra from found join rec l on l.entity_id = s1 join rec r on r.entity_id = cand),
        y as (select s1, cand, round(0.5 * {_jaccard(_found('ln'), _found('rn'))} + 0.3 * {_jaccard(_found('la'), _found('ra'))} + 0.2 * {_jaccard(_grams('ln'), _grams('rn'))}, 6) as score from x),
        z as (select * from y where score >= 0.5 qualify row_number() over (partition by cand order by score desc, s1) = 1)
        select source1_entity_id, coalesce(string_agg(cand, ',' order by score desc, cand), '') as matched_entity_ids from manifest left join z on s1 = source1_entity_id group by 1""",
    "hit_union": f"with {KEYS} select * from united",
    "early_exit_gate": f"with {KEYS} select s1 from united group by s1 having (max(mask & 255) > 0 and count(*) >= 8) or count(*) >= 10",
    "candidate_priority": f"with {PLACED} select s1, cand, score, rank, place, names[2:] as provenance from named",
    "candidate_pairs": f"with {PLACED}, {MANIFEST} select source1_entity_id, coalesce(string_agg(cand, ',' order by place), '') as candidate_entity_ids from manifest left join placed on s1 = source1_entity_id group by source1_entity_id",
    "blocking_summary": f"""with {PLACED}, {MANIFEST}, per as (select source1_entity_id, count(cand) as n from manifest left join placed on s1 = source1_entity_id group by all)
        select count(*) as entities, cast(sum(n) as bigint) as pairs, round(avg(n), 6) as mean, quantile_cont(n, 0.5) as median, round(quantile_cont(n, 0.9), 6) as p90, round(quantile_cont(n, 0.95), 6) as p95, max(n) as most from per""",
    "channel_contrib": f"with {PLACED} select channel, count(*) as pairs from (select unnest(string_split(names[2:], ',')) as channel from named) group by channel",
    "recall_audit": f"with {PLACED}, {TRUTH}, {PER} select {AUDIT} from per",
    "recall_by_country": f"with {PLACED}, {TRUTH}, {PER} select country, {AUDIT} from per group by country",
    "recall_by_channel": f"""with {PLACED}, {TRUTH}, f as (select unnest(string_split(names[2:], ',')) as channel from named join truth on s1 = source1_entity_id and cand = candidate_entity_id)
        select channel, count(*) as found, round(count(*) / (select count(*) from truth), 6) as recall from f group by channel""",
    "needed_ids": f"with {FEED} select entity_id, country from feed where doc_id in (select doc_id from labels where quality = 0)",
    "gt_explode": f"with {TRUTH} select distinct source1_entity_id, candidate_entity_id from truth",
    "multi_claim_check": f"with {TRUTH} select candidate_entity_id, count(distinct source1_entity_id) as claims from truth group by candidate_entity_id having claims > 1",
    "match_degree_hist": f"with {TRUTH} select degree, count(*) as entities from (select count(*) as degree from truth group by source1_entity_id) group by degree",
    "missingness_profile": f"""with {FEED} select entity_id[1:2] as source, count(*) as n, round(avg({_missing('business_address')}::int), 6) as missing_address, round(avg(regexp_matches(business_name, '[^\\x00-\\x7F]')::int), 6) as non_ascii,
        round(avg(length(business_name)), 6) as mean_length, quantile_cont(length(business_name), 0.5) as median_length, quantile_cont(length(business_name), 0.95) as p95_length, cast(max(length(business_name)) as integer) as longest from feed group by 1""",
    "dataset_statistics": f"""with {FEED}, {TRUTH}, a as (select count(*) filter (entity_id[1:2] = 'S1') as s1_rows, count(*) filter (entity_id[1:2] <> 'S1') as candidate_rows from feed), b as (select count(*) as positive_pairs, count(distinct source1_entity_id) as w from truth)
        select s1_rows, candidate_rows, positive_pairs, s1_rows - w as singletons, s1_rows * candidate_rows as full_product from a, b""",
    "country_label_pivot": f"with {LABELLED} select lang as country, count(*) filter (label = 0) as negatives, count(*) filter (label = 1) as positives from labelled group by lang",
    "pair_jaccard": f"""with {PAIRS} select lk, rk, round({_jaccard(_found('ln'), _found('rn'))}, 6) as name_jaccard, round({_overlap(_found('ln'), _found('rn'))}, 6) as name_overlap,
        round({_jaccard(_grams('ln'), _grams('rn'))}, 6) as name_trigram, round({_overlap("regexp_extract_all(la, '[0-9]+')", "regexp_extract_all(ra, '[0-9]+')")}, 6) as address_numbers from pairs""",
    "pair_edit": f"with {PAIRS} select lk, rk, {_edit('ln', 'rn')} as name_edit, {_edit('la', 'ra')} as address_edit from pairs",
    "pair_margin": f"with {PLACED} select s1 as source1_entity_id, cand as candidate_entity_id, round(score, 4) as score, round(max(score) over (partition by s1) - score, 4) as diff from placed",
    "pair_flags": f"with {PAIRED} select s1 as source1_entity_id, cand as candidate_entity_id, {FLAGS} from pf",
    "pair_features": f"""with {PAIRED} select s1 as source1_entity_id, cand as candidate_entity_id, lc as left_country, rc as right_country, lcc as left_country_canonical, rcc as right_country_canonical, {FLAGS},
        (lcc = '' or rcc = '')::int as country_equal_missing, (lc = '')::int as left_country_missing, (rc = '')::int as right_country_missing, (ln = '' and rn = '')::int as name_both_missing, (la = '' and ra = '')::int as address_both_missing,
        {_set_measure(_jaccard, "ln", "rn")} as name_jaccard, {_set_measure(_overlap, "ln", "rn")} as name_overlap, {_edit("ln", "rn")} as name_edit_similarity, {_set_measure(_jaccard, "ln", "rn", _grams)} as name_char_trigram_jaccard,
        {_set_measure(_jaccard, "la", "ra")} as address_jaccard, {_set_measure(_overlap, "la", "ra")} as address_overlap, {_edit("la", "ra")} as address_edit_similarity, {_set_measure(_jaccard, "la", "ra", _grams)} as address_char_trigram_jaccard,
        round({_overlap(_digits("ln"), _digits("rn"))}, 6) as name_number_overlap, round({_overlap(_digits("la"), _digits("ra"))}, 6) as address_number_overlap, (lp = rp and lp <> '')::int as postal_equal, (lp = '' or rp = '')::int as postal_missing_either,
        0 as candidate_rank_missing, round(sc, 6) as best_blocker_score, 0 as best_blocker_score_missing, round(most - sc, 6) as best_blocker_score_diff, 0 as best_blocker_score_diff_missing, 1 as has_blocker_provenance, prov as blocker_provenance from pf""",
    "match_split": f"""with {TRUTH}, c as (select count(*) filter (candidate_entity_id[1:2] = 'S2') as a, count(*) filter (candidate_entity_id[1:2] = 'S3') as b from truth group by source1_entity_id),
        k as (select case when a > 0 and b > 0 then 'both' when a > 0 then 's2_only' else 's3_only' end as kind from c union all select 'several_s2' from c where a > 1 union all select 'several_s3' from c where b > 1)
        select kind, count(*) as entities from k group by kind""",
    "pair_profile": f"""with {PLACED}, {TRUTH}, both_ as (select distinct source1_entity_id as s1, candidate_entity_id as cand, 1 as label from truth union all select s1, cand, 0 from placed p where not exists (select 1 from truth t where t.source1_entity_id = p.s1 and t.candidate_entity_id = p.cand)),
        x as (select label, l.norm_name as ln, r.norm_name as rn, l.norm_address as la, r.norm_address as ra from both_ join rec l on l.entity_id = s1 join rec r on r.entity_id = cand),
        m as (select label, (ln = rn and ln <> '')::int as name_exact, {_jaccard(_found('ln'), _found('rn'))} as name_jaccard, case when ln = rn then 1.0 when ln = '' or rn = '' then 0.0 else 1.0 - levenshtein({_ascii('ln')}, {_ascii('rn')}) / greatest(length(ln), length(rn)) end as name_edit,
            (la = ra and la <> '')::int as address_exact, {_jaccard(_found('la'), _found('ra'))} as address_jaccard, case when la = ra then 1.0 when la = '' or ra = '' then 0.0 else 1.0 - levenshtein({_ascii('la')}, {_ascii('ra')}) / greatest(length(la), length(ra)) end as address_edit from x)
        select label, count(*) as n, {", ".join(f"round(avg({c}), 6) as {c}_mean, round(quantile_cont({c}, 0.5), 6) as {c}_median" for c in ("name_exact", "name_jaccard", "name_edit", "address_exact", "address_jaccard", "address_edit"))},
            {", ".join(f"round(avg((name_jaccard >= {c / 100})::int), 6) as kept_{c}" for c in (20, 30, 40))} from m group by label""",
    "hard_negatives": f"""with {PLACED}, {TRUTH}, neg as (select s1, cand, place, r.norm_name as text from placed join rec l on l.entity_id = s1 join rec r on r.entity_id = cand where r.norm_name <> '' and r.norm_name <> l.norm_name
            and not exists (select 1 from truth t where t.source1_entity_id = s1 and t.candidate_entity_id = cand) and not exists (select 1 from truth t join rec g on g.entity_id = t.candidate_entity_id where t.source1_entity_id = s1 and g.norm_name = r.norm_name))
        select s1 as source1_entity_id, cand as candidate_entity_id, cast(row_number() over (partition by s1 order by place, cand) as integer) as n from neg qualify n <= 5""",
    "training_pairs": f"""{TRAINING} select * from training""",
    "flat_training_pairs": f"{TRAINING} select anchor, positive, negatives[1] as negative_1, negatives[2] as negative_2 from training where len(negatives) >= 2",
    "dense_by_country": """with v as (select vec_id as id, embedding as v, ['', 'us', 'india', 'france'][vec_id % 4 + 1] as country from embeddings),
        s as materialized (select q.id as q, c.id as c, q.country as qc, c.country as cc, round(list_sum(list_transform(list_zip(q.v, c.v), lambda p: cast(p[1] as double) * p[2])), 9) as sim from v q join v c on q.id <> c.id where q.id % 5 = 0),
        own as (select q, c, sim from s where (qc = cc or cc = '') and sim >= 0.3), other as (select q, c, sim * 0.95 as sim from s where qc <> cc and not (qc in ('us', 'india') and cc in ('us', 'india')) and sim * 0.95 >= 0.3 and q not in (select q from own))
        select q as s1, c as cand, cast(row_number() over (partition by q order by round(sim, 6) desc, c) as integer) as rank from (select * from own union all select * from other) qualify rank <= 5""",
    "feature_merge": f"with {SCORED} select source1_entity_id, candidate_entity_id, round(calibrated_score, 6) as score, case when calibrated_score >= 0.5 then round(calibrated_score * 2, 6) end as bge_cosine, case when calibrated_score >= 0.5 then 0 else 1 end as bge_cosine_missing from scored",
    "label_attach": f"with {SCORED} select source1_entity_id, candidate_entity_id, case when calibrated_score * cast(10007 as double) % 3 < 1 then 1 else 0 end as label from scored",
    "neg_subsample": f"""with {SCORED}, r as (select source1_entity_id, candidate_entity_id, cast(row_number() over (partition by source1_entity_id order by calibrated_score desc, candidate_entity_id) as integer) as candidate_rank, case when calibrated_score * cast(10007 as double) % 3 < 1 then 1 else 0 end as label from scored)
        select * from r qualify label = 1 or row_number() over (partition by source1_entity_id, label order by candidate_rank, candidate_entity_id) <= 6""",
    "sentinel_fill": """select cast(p_partkey as varchar) as source1_entity_id, case when p_size > 25 then cast(p_size as double) else 999.0 end as candidate_rank, cast(1.0 as double) as bge_cosine_missing, case when p_size > 10 then cast(0.5 as double) else -1.0 end as best_blocker_score from part""",
    "injective_match": f"with {SCORED} select source1_entity_id, candidate_entity_id from claimed where calibrated_score >= 0.5",
    "noninjective_match": f"""with {SCORED} select 'S1-' || c_custkey as source1_entity_id, coalesce(string_agg(candidate_entity_id, ',' order by calibrated_score desc, candidate_entity_id), '') as matched_entity_ids
        from customer left join scored on source1_entity_id = 'S1-' || c_custkey and calibrated_score >= 0.9 group by 1""",
    "match_results": f"with {MATCHED} select * from matched",
    "validator_report": f"""with {MATCHED}, bad as materialized (select source1_entity_id as s, case when source1_entity_id like '%7' then 'S1-1,X-2,S2-4,S2-4' else matched_entity_ids end as m from matched), ids as (select s, unnest(string_split(m, ',')) as id from bad where m <> ''), one as (select s, id, count(*) as n from ids group by all)
        select 'duplicate_id' as rule, s as subject, id, 'error' as level from one where n > 1 union all select 'self_id', s, id, 'error' from one where id like 'S1-%' union all select 'bad_prefix', s, id, 'error' from one where not regexp_matches(id, '^S[123]-')""",
    "macro_f05": f"""with {SCORED}, k as (select c.source1_entity_id as s, count(*) as p, count(m.candidate_entity_id) as r from claimed c left join marked m using (source1_entity_id, candidate_entity_id) where calibrated_score >= 0.5 group by 1),
        a as (select source1_entity_id as s, count(*) as a from marked group by 1), e as (select coalesce(p, 0) as p, coalesce(r, 0) as r, coalesce(a, 0) as a from customer left join k on k.s = 'S1-' || c_custkey left join a on a.s = 'S1-' || c_custkey)
        select count(*) as entities, round(avg({HALF}), 6) as macro_f05, round(sum(r) / sum(p), 6) as pair_precision, round(sum(r) / sum(a), 6) as pair_recall from e""",
    "threshold_sweep": f"""with {SCORED}, g as (select unnest([0.0, {", ".join(str(round(0.05 + 0.01 * i, 2)) for i in range(91))}, 1.0])::double as threshold), a as (select source1_entity_id as s, count(*) as a from marked group by 1),
        k as (select threshold, c.source1_entity_id as s, count(*) as p, count(m.candidate_entity_id) as r from claimed c join g on calibrated_score >= threshold left join marked m using (source1_entity_id, candidate_entity_id) group by all),
        f as (select g.threshold, coalesce(k.p, 0) as p, coalesce(k.r, 0) as r, coalesce(a.a, 0) as a from customer cross join g left join k on k.s = 'S1-' || c_custkey and k.threshold = g.threshold left join a on a.s = 'S1-' || c_custkey)
        select threshold, round(avg({HALF}), 6) as macro_f05 from f group by threshold""",
    "ece_bins": f"with {LABELLED} select cast(least(floor(score * 10), 9) as integer) as bin, count(*) as n, round(avg(score), 6) as mean_p, round(avg(label), 6) as mean_y from labelled group by 1",
    "calibration_metrics": f"""with {LABELLED}, b as (select least(floor(score * 10), 9) as b, count(*) as n, avg(score) as mp, avg(label) as my from labelled group by 1), q as (select *, greatest(1e-15, least(1 - 1e-15, score)) as p from labelled)
        select round((select sum(abs(mp - my) * n) / sum(n) from b), 6) as ece, round(avg((score - label) * (score - label)), 6) as brier, round(avg(-case when label = 1 then ln(p) else ln(1 - p) end), 6) as log_loss from q""",
    "avg_precision": f"""with {LABELLED}, b as (select score, count(*) as n, sum(label) as hit from labelled group by score), c as (select *, sum(n) over (order by score desc) as seen, sum(hit) over (order by score desc) as r from b)
        select round(sum(hit / (select sum(label) from labelled) * r / seen), 6) as average_precision from c""",
    "classifier_metrics": f"""with {LABELLED}, c as (select count(*) as n, count(*) filter (score >= 0.7 and label = 1) as tp, count(*) filter (score >= 0.7 and label = 0) as fp, count(*) filter (score < 0.7 and label = 1) as fn from labelled), d as (select *, tp / (tp + fp) as p, tp / (tp + fn) as r from c)
        select round(1 - (fp + fn) / n, 6) as accuracy, round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / (p + r), 6) as f1, round(1.25 * p * r / (0.25 * p + r), 6) as pair_f05 from d""",
    "dense_topk": f"with {SIMS} select q, c, cast(row_number() over (partition by q order by sim desc, c) as integer) as rank from sims qualify rank <= 10",
    "retrieval_metrics": f"""with {SIMS}, r as (select *, row_number() over (partition by q order by sim desc, c) as k from sims), p as (select q, count(*) filter (rel) as total, count(*) filter (rel and k <= 1) as h1, count(*) filter (rel and k <= 5) as h5, count(*) filter (rel and k <= 10) as h10, min(k) filter (rel) as f from r group by q having total > 0)
        select round(avg(h1 / total), 6) as recall_at_1, round(avg(h5 / total), 6) as recall_at_5, round(avg(h10 / total), 6) as recall_at_10, round(avg(h1 / 1), 6) as precision_at_1, round(avg(h5 / 5), 6) as precision_at_5, round(avg(h10 / 10), 6) as precision_at_10,
            round(avg(1 / f), 6) as mrr, round(avg(case when f <= 10 then 1 / f else 0 end), 6) as mrr_at_10 from p""",
    "margin_analysis": f"""with {SIMS}, m as (select max(sim) filter (rel) - max(sim) filter (not rel) as margin from sims group by q), k as (select margin from m where margin is not null)
        select count(*) as n, round(avg(margin), 6) as mean_margin, round(quantile_cont(margin, 0.5), 6) as median_margin, round(avg((margin >= 0.1)::int), 6) as pass_10, round(avg((margin >= 0.3)::int), 6) as pass_30 from k""",
}
