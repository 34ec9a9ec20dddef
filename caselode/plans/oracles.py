"""DuckDB statements with the rows of the registered queries."""

from caselode.functions import fixed
from caselode.functions.text import porter
from caselode.plans import workloads as L

TOKEN = r"[\p{L}\p{N}]+(?:[-''][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"


def lit(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def values(rows, names: str) -> str:
    return f"(values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) as v({names})"


BASE = f"""
cases as (
  select cast(doc_id as varchar) as document_id, string_split(coalesce(text, ''), chr(10))[1] as title, coalesce(text, '') as content,
         case when try_cast(regexp_extract(source, '^src([0-9]{{1,3}})$', 1) as integer) between 0 and {len(fixed.HIGH_COURTS) - 1} then 'H'
              when try_cast(regexp_extract(source, '^src([0-9]{{1,3}})$', 1) as integer) between {len(fixed.HIGH_COURTS)} and {len(fixed.HIGH_COURTS) + len(fixed.MEDIUM_COURTS) - 1} then 'M' else 'L' end as importance
  from documents),
kept as (select * from cases where not regexp_matches(title, '^[\\x{{4e00}}-\\x{{9fff}}]')),
zones as (
  select document_id, 't' as zone, document_id || '.t' as zone_doc_id, title as text, importance from kept
  union all select document_id, 'c', document_id || '.c', content, importance from kept),
tok as (
  select document_id, zone, zone_doc_id, importance, w[i + 1] as term, i as pos
  from (select *, unnest(range(0, len(w))) as i from (select *, regexp_extract_all(lower(text), '{TOKEN}') as w from zones))),
post as (select term, zone_doc_id, document_id, zone, importance, count(*) as tf from tok group by all),
dict as (select term, count(*) as df from post group by term),
nn as (select count(*) as n from zones)"""


def scores(terms: str, name: str = "zs") -> str:
    """CTEs: ``name`` has the zone scores of ``terms``."""
    return f"""
{name} as (
  select query_id, zone_doc_id, document_id, zone,
         sum((1 + log10(qtf)) * log10(n::double / df) * (1 + log10(tf))) * max(case importance when 'H' then 10.0::double when 'M' then 8.5::double else 1.0::double end) as zscore
  from post join dict using (term) join {terms} using (term), nn group by query_id, zone_doc_id, document_id, zone)"""


def ranked(scores: str, content: float = 0.8, title: float = 0.2) -> str:
    return f"""
fold as (
  select query_id, document_id, sum(case zone when 'c' then {content}::double else {title}::double end * zscore) as score, max({{'z': zscore, 'i': zone_doc_id}}) as best
  from {scores} group by query_id, document_id),
ranked as (
  select query_id, document_id, round(score, 6) as score,
         row_number() over (partition by query_id order by round(score, 6) desc, round(best.z, 6) desc, best.i desc) - 1 as rank from fold)"""


TERMS = "(select term, 'q' as query_id, count(*) as qtf from " + values([(w,) for w in L.RANKED], "term") + " group by term)"
STOP = "(" + ", ".join(map(lit, fixed.STOPWORDS)) + ")"
TOPS = f"""
tops as (
  select * from (select zone_doc_id, term, tf, row_number() over (partition by zone_doc_id order by tf desc, term desc) as place from post where length(term) > 2 and term not in {STOP})
  where place <= 5)"""
SETS = values([(i, w) for i, ws in enumerate(fixed.SYNONYM_SETS) for w in ws], "set_id, synonym")
PLAIN = "(select query_id, unnest(string_split(query, ' ')) as token from " + values(L.PLAIN, "query_id, query") + ")"
EXPANDED = f"""
raw as (select * from {PLAIN}),
sets as (select * from {SETS}),
expanded as (
  select query_id, token from raw
  union all select query_id, b.synonym from raw join sets a on a.synonym = token join sets b on b.set_id = a.set_id)"""


def strict(clauses: list[list[str]]) -> str:
    rows = [(c, o, w, len(ws)) for c, ws in enumerate(clauses) for o, w in enumerate(ws)]
    return f"""with {BASE},
words as (select * from {values(rows, "clause, o, term, width")}),
starts as (select clause, width, zone_doc_id, document_id, pos - o as start from tok join words using (term) group by all having count(*) = width),
found as (select clause, zone_doc_id, document_id, count(*) as freq from starts group by all),
sizes as (select clause, count(*) as zones from found group by clause),
rarest as (select clause from sizes order by zones, clause limit 1)
select zone_doc_id, document_id, max(case when clause = (select clause from rarest) then freq end) as freq
from found group by zone_doc_id, document_id having count(*) = {len(clauses)}"""


LEXICON = values([(form, lemma) for lemma, forms in fixed.IRREGULAR_VERBS.items() for form in forms.split()], "surface, lemma")
LEMMATISED = BASE.replace("tok as (", "raw_tok as (").replace("post as (", f"lex as (select surface, min(lemma) as lemma from {LEXICON} group by surface),\ntok as (select document_id, zone, zone_doc_id, importance, coalesce(lemma, term) as term, pos from raw_tok left join lex on surface = term),\npost as (", 1)


def searched(mode: str) -> str:
    """The ranked ids of ``SEARCHED``, from the lemmatised collection."""
    if mode == "strict":
        clauses = {"one": [["the"], ["la"], ["tion"], ["der"]], "two": [["of", "the"], ["in"], ["to", "the"]], "five": [["und"], ["die"]]}
        rows = [(q, c, o, w, len(ws), len(cs)) for q, cs in clauses.items() for c, ws in enumerate(cs) for o, w in enumerate(ws)]
        return f"""with {LEMMATISED},
words as (select * from {values(rows, "query_id, clause, o, term, width, clauses")}),
starts as (select query_id, clauses, clause, width, zone_doc_id, document_id, pos - o as start from tok join words using (term) group by all having count(*) = width),
found as (select query_id, clauses, clause, zone_doc_id, document_id, count(*) as freq from starts group by all),
sizes as (select query_id, clause, count(*) as zones from found group by all),
rarest as (select query_id, min({{'z': zones, 'c': clause}}).c as rarest from sizes group by query_id),
zone_hits as (select query_id, zone_doc_id, document_id, max(case when clause = rarest then freq end) as freq from found join rarest using (query_id) group by query_id, clauses, zone_doc_id, document_id having count(*) = clauses),
docs as (select query_id, document_id, sum(freq) as score, max({{'f': freq, 'z': zone_doc_id}}) as best from zone_hits group by all)
select query_id, row_number() over (partition by query_id order by score desc, best.f desc, best.z desc) - 1 as rank, document_id from docs"""
    rows = [("one", w) for w in ("the", "la", "tion", "der")] + [("two", w) for w in ("of", "the", "in", "to", "the")] + [("four", w) for w in ("absent-word",)] + [("five", w) for w in ("und", "die")]
    plain = f"(select query_id, token from {values(rows, 'query_id, token')})"
    members = fixed.FEEDBACK_SYNONYM_SETS if mode == "feedback" else fixed.SYNONYM_SETS
    sets = values([(i, w) for i, ws in enumerate(members) for w in ws], "set_id, synonym")
    lemmas = {form: lemma for lemma, forms in fixed.IRREGULAR_VERBS.items() for form in forms.split()}
    words = {w for _, t in rows for w in (t, lemmas.get(t, t))} | {w for ws in members for s in ws for t in s.lower().split() for w in (t, lemmas.get(t, t))}
    stems = values(sorted((w, porter(w)) for w in words), "word, stem")
    term = "coalesce(stem, lemma, term)" if mode == "feedback" else "coalesce(lemma, term)"
    made = f"""with {LEMMATISED},
sets as (select * from {sets}),
expanded as (select query_id, token from {plain} union all select query_id, b.synonym from {plain} join sets a on a.synonym = token join sets b on b.set_id = a.set_id),
terms as (
  select query_id, {term} as term, count(*) as qtf from (select query_id, unnest(regexp_extract_all(lower(token), '{TOKEN}')) as term from expanded)
  left join lex on surface = term left join (select * from {stems}) on word = coalesce(lemma, term) group by all),
{scores('terms')}"""
    if mode == "ranked":
        return f"{made}, {ranked('zs')} select query_id, rank, document_id from ranked"
    return f"""{made}, {TOPS},
best as (select * from zs qualify row_number() over (partition by query_id order by zscore desc, zone_doc_id desc) <= 5),
more as (select query_id, term, count(*) as qtf from best join tops using (zone_doc_id) group by all),
again as (select query_id, term, cast(sum(qtf) as bigint) as qtf from (select * from terms union all select * from more) group by all), {scores('again', 'za')},
cut as (select * from za qualify row_number() over (partition by query_id order by zscore desc, zone_doc_id desc) <= 3500), {ranked('cut', 0.5, 0.5)} select query_id, rank, document_id from ranked"""


def sql() -> dict[str, str]:
    return {
        "boolean_rank": f"select *, row_number() over (order by freq desc, zone_doc_id) - 1 as rank from ({strict([['of', 'the'], ['in'], ['to', 'the']])})",
        "case_csv": "select cast(doc_id as varchar) as document_id, length(string_split(coalesce(text, ''), chr(10))[1]) as title_chars, length(coalesce(text, '')) as content_chars, coalesce(case when try_cast(regexp_extract(source, '^src([0-9]{1,3})$', 1) as integer) >= 0 then ([" + ", ".join(map(lit, (*fixed.HIGH_COURTS, *fixed.MEDIUM_COURTS))) + "])[try_cast(regexp_extract(source, '^src([0-9]{1,3})$', 1) as integer) + 1] end, '') as court from documents",
        "index_lookup": f"with {LEMMATISED} select term, zone_doc_id, count(*) as tf, df, string_agg(cast(pos as varchar), ',' order by pos) as positions from tok join dict using (term) where term in ({', '.join(map(lit, L.LOOKUPS))}) group by term, zone_doc_id, df",
        "search_ranked": searched("ranked"),
        "search_feedback": searched("feedback"),
        "search_strict": searched("strict"),
        "expand_thesaurus": f"""with raw as (select query_id, unnest(string_split(query, ' ')) as token from {values(L.UNKNOWN, 'query_id, query')}), sets as (select * from {SETS}),
f as (select term, synonym, min(rank) as rank from {values(L.THESAURUS, 'term, pos, rank, synonym')} where regexp_matches(synonym, '^[\\p{{L}}\\p{{N}}]+$') and synonym <> term and synonym <> 'AND' group by term, synonym),
p as (select * from f qualify row_number() over (partition by term order by rank, synonym) <= 3)
select query_id, token, count(*) as n from (
  select query_id, token from raw union all select query_id, b.synonym from raw join sets a on a.synonym = token join sets b on b.set_id = a.set_id
  union all select query_id, p.synonym from raw join p on term = token where token not in (select synonym from sets)) group by all""",
        "zone_unpivot": f"with {BASE} select document_id, zone, zone_doc_id, importance, case importance when 'H' then 10.0::double when 'M' then 8.5::double else 1.0::double end as multiplier, length(text) as n_chars from zones",
        "cjk_filter": f"select * from {values(L.TITLES, 'document_id, title')} where not regexp_matches(coalesce(title, ''), '^[\\x{{4e00}}-\\x{{9fff}}]')",
        "courts": f"select court, multiplier::double as multiplier from {values(L.COURTS, 'court, multiplier')}",
        "tokenize_positions": f"with {BASE} select zone_doc_id, count(*) as n_tokens, max(pos) as last_pos, cast(sum(pos * length(term)) as bigint) as position_sum from tok group by zone_doc_id",
        "lemma_join": f"with {BASE}, lex as (select * from {values(L.LEXICON, 'surface, pos, lemma')}) select zone, coalesce(lemma, term) as term, count(*) as n from tok left join lex on surface = term and lex.pos = case zone when 't' then 'n' else 'v' end group by 1, 2",
        "postings_tf": f"with {BASE} select term, zone_doc_id, tf from post",
        "positional_postings": f"with {BASE} select term, zone_doc_id, count(*) as tf, string_agg(cast(pos as varchar), ',' order by pos) as positions from tok group by term, zone_doc_id",
        "doc_freq_idf": f"with {BASE} select term, df, round(log10(n::double / df), 6) as idf from dict, nn",
        "corpus_n": f"with {BASE} select n from nn",
        "doc_length": f"with {BASE}, s as (select zone_doc_id, sum(pow(1 + log10(tf), 2)) as s from post group by 1) select zone_doc_id, round(sqrt(coalesce(s, 0)), 6) as doc_length from zones left join s using (zone_doc_id)",
        "parse_query_types": f"select query_id, type, n_clauses::bigint as n_clauses, n_raw::bigint as n_raw from {values([(q, t, c, r) for q, _, t, c, r in L.QUERIES], 'query_id, type, n_clauses, n_raw')}",
        "expand_custom": f"with {EXPANDED} select query_id, token, count(*) as n from expanded group by all",
        "expand_topk": f"""with t as (select * from {values(L.THESAURUS, 'term, pos, rank, synonym')}), w as (select * from {values(L.WORDS, 'term, pos')}),
f as (select term, synonym, min(rank) as rank from t join w using (term, pos) where regexp_matches(synonym, '^[\\p{{L}}\\p{{N}}]+$') and synonym <> term and synonym <> 'AND' group by term, synonym)
select * from (select term, synonym, row_number() over (partition by term order by rank, synonym) as place from f) where place <= 3""",
        "query_tf": f"with {EXPANDED} select query_id, term, count(*) as qtf from (select query_id, unnest(regexp_extract_all(lower(token), '{TOKEN}')) as term from expanded) group by all",
        "rank_free_text": f"with {BASE}, terms as (select * from {TERMS}), {scores('terms')}, {ranked('zs')} select query_id, rank, document_id, score from ranked",
        "rank_batch_topk": f"with {BASE}, terms as (select query_id, term, count(*) as qtf from (select cast(item_id as varchar) as query_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) as term from benchmark) group by all), {scores('terms')}, {ranked('zs')} select query_id, rank, document_id, score from ranked where rank < 10",
        "boolean_and": strict([["the"], ["of"]]),
        "phrase_match": strict([["of", "the"]]),
        "boolean_phrase": strict([["of", "the"], ["in"], ["to", "the"]]),
        "top_terms": f"with {BASE}, {TOPS} select zone_doc_id, term, tf, place from tops",
        "prf_rank": f"""with {BASE}, {TOPS}, terms as (select * from {TERMS}), {scores('terms')},
best as (select zone_doc_id from zs order by zscore desc, zone_doc_id desc limit 5),
more as (select term, count(*) as qtf from best join tops using (zone_doc_id) group by term),
again as (select 'q' as query_id, term, cast(sum(qtf) as bigint) as qtf from (select term, qtf from terms union all select term, qtf from more) group by term), {scores('again', 'za')},
cut as (select * from za order by zscore desc, zone_doc_id desc limit 3500), {ranked('cut', 0.5, 0.5)} select query_id, rank, document_id, score from ranked""",
        "bonus_zone_fold": f"with {BASE}, terms as (select * from {TERMS}), {scores('terms')}, cut as (select * from zs order by zscore desc, zone_doc_id desc limit 3500) select document_id, round(sum(0.5::double * zscore), 6) as score from cut group by document_id",
        "rocchio_weights": f"""with {BASE}, {TOPS}, terms as (select * from {TERMS}), {scores('terms')},
best as (select zone_doc_id from zs order by round(zscore, 6) desc, zone_doc_id desc limit 5),
more as (select term, count(*) as f from best join tops using (zone_doc_id) group by term)
select term, round(0.8::double * coalesce(qtf, 0) + 0.2::double * coalesce(f, 0) / 5, 6) as weight from terms full join more using (term)""",
        "relevance_rank": f"with {BASE}, terms as (select * from {TERMS}), {scores('terms')}, {ranked('zs')}, rel as (select distinct cast(doc_id as varchar) as document_id from labels where quality = 1) select document_id, coalesce(rank, -1)::bigint as rank from rel left join ranked using (document_id)",
        "duplicate_postings": f"""with a as (select * from {values(L.ARRIVALS, 'arrival, term, zone_doc_id, pos')}),
f as (select *, case when lag(zone_doc_id) over (partition by term order by arrival, pos) = zone_doc_id then 0 else 1 end as fresh from a),
g as (select *, sum(fresh) over (partition by term order by arrival, pos rows unbounded preceding) as posting from f)
select term, posting::bigint as posting, zone_doc_id, count(*) as tf, string_agg(cast(pos as varchar), ',' order by arrival, pos) as positions from g group by term, posting, zone_doc_id""",
        "porter_stems": f"select * from {values(L.STEMS, 'word, stem')}",
    }
