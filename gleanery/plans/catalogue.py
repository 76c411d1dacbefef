"""Every query of the engine by name, with its SQL twin where SQL can express it.

The driver's tables stand in for a corpus: docket = source, id = doc_id, attachments = conversations (conv_id = doc_id, in order
of turn), duplicateComments = n_chars % 7 (0: not populated), keys = urls, series numbers = labels.doc_id, two labellers =
quality and 1 - toxic, vectors = embeddings. Rules that those tables never trigger get lines of their own into every few texts of theirs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import minhash as M
from gleanery.functions import text as T
from gleanery.operators import coverage, embedding, evaluate, labels, linkage, metrics, responses
from gleanery.operators.components import connected_components
from gleanery.plans import docket
from gleanery.session import table
from gleanery.sources import records

#: For vectors of the driver's tables, whose cosines stay far below the ladder's own threshold.
COSINE = 0.30
JACCARD = docket.JACCARD
SIG, BANDS, ROWS = 128, 32, 4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents; a table in one file is read by one task, so it is dealt to all cores."""
    docs = table(spark, sf, "documents")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores, "doc_id") if docs.rdd.getNumPartitions() < cores else docs


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _dealt(values: list[str | None], column: str) -> F.Column:
    """One of the values for each row, by the column's remainder."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.col(column) % len(values) + 1).cast("int"))


def _dealt_sql(values: list[str | None], column: str) -> str:
    return "[" + ", ".join("null" if v is None else _sql(v) for v in values) + f"][({column}) % {len(values)} + 1]"


WS = r"[\s\v]+"
CANON = rf"trim(regexp_replace(lower(coalesce({{}}, '')), '{WS}', ' ', 'g'))"
SPACE_SQL = rf"trim(regexp_replace({{}}, '{WS}', ' ', 'g'))"
KEYED = f"keyed as (select doc_id, source, text, n_chars, sha256({CANON.format('text')}) as k from documents), clustered as (select *, min(doc_id) over (partition by k) as cluster_id from keyed)"
STATS = "count(*) as clusters, sum(n)::bigint as records, max(n) as largest_records, max(subs)::bigint as largest_submissions, count(*) filter (n = 1) as singletons, count(*) filter (n > 1) as multi"

# The exact rung and what it says.


@query(f"with {KEYED} select doc_id, k as exact_key, cluster_id, count(*) over (partition by k) as size from clustered")
def exact_clusters(spark, sf):
    rows = _docs(spark, sf).select("doc_id", T.exact_key("text").alias("exact_key"))
    heads = rows.groupBy("exact_key").agg(F.min("doc_id").alias("cluster_id"), F.count("*").alias("size"))
    return rows.join(heads, "exact_key").select("doc_id", "exact_key", "cluster_id", "size")


@query(f"""with {KEYED}, per as (select source, k, count(*) as n, sum(n_chars % 7) as subs from keyed group by 1, 2), stats as (select source, {STATS} from per group by 1)
select *, 'exact' as rung, records / clusters as collapse_vs_records, 100 * (1 - clusters / records) as extra_collapse_pct from stats""")
def exact_ladder_by_source(spark, sf):
    rows = _docs(spark, sf).select("source", T.exact_key("text").alias("cluster_id"), (F.col("n_chars") % 7).alias("dc"))
    return metrics.ladder(metrics.cluster_stats(rows, ["source"], "dc"), "exact")


VARIANTS = {
    "as_is": ("text", lambda t: t),
    "lower": ("lower(text)", lambda t: F.lower(t)),
    "spaces": (SPACE_SQL.format("text"), lambda t: T.normalize_space(t)),
    "canonical": (CANON.format("text"), lambda t: T.canonical(t)),
    "letters": (f"regexp_replace({CANON.format('text')}, '[^a-z0-9 ]', '', 'g')", lambda t: F.regexp_replace(T.canonical(t), "[^a-z0-9 ]", "")),
    "words_sorted_out": (f"regexp_replace({CANON.format('text')}, '[0-9]+', '#', 'g')", lambda t: F.regexp_replace(T.canonical(t), "[0-9]+", "#")),
}


@query("select " + ", ".join(f"count(*) - count(distinct {s}) as {n}" for n, (s, _) in VARIANTS.items()) + " from documents")
def exact_sensitivity_variants(spark, sf):
    """Redundant copies under six normalisations, counted in one pass."""
    t = F.col("text")
    return _docs(spark, sf).select(*(F.sha2(f(t).cast("binary"), 256).alias(n) for n, (_, f) in VARIANTS.items())).agg(*((F.count("*") - F.count_distinct(n)).alias(n) for n in VARIANTS))


@query(f"""with {KEYED}, copies as (select length({CANON.format('text')}) as l, row_number() over (partition by k order by doc_id) as r from keyed)
select case when l < 500 then 'under 500' when l < 2000 then '500 to 1999' else '2000 and over' end as band, count(*) as copies, sum(l)::bigint as chars from copies where r > 1 group by 1""")
def excess_copy_lengths(spark, sf):
    rows = _docs(spark, sf).select("doc_id", T.exact_key("text").alias("k"), F.length(T.canonical("text")).alias("l"))
    extra = rows.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("doc_id"))).where("r > 1")
    band = F.when(F.col("l") < 500, "under 500").when(F.col("l") < 2000, "500 to 1999").otherwise("2000 and over")
    return extra.groupBy(band.alias("band")).agg(F.count("*").alias("copies"), F.sum("l").cast("long").alias("chars"))


@query(f"""with {KEYED}, per as (select source, sum(n_chars) as n, count(*) / count(distinct k) as c from keyed group by 1),
r as (select rank() over (order by n) + (count(*) over (partition by n) - 1) / 2.0 as rn, rank() over (order by c) + (count(*) over (partition by c) - 1) / 2.0 as rc from per)
select round(corr(rn, rc), 6) as rho, count(*) as n from r""")
def collapse_spearman(spark, sf):
    """Rank correlation of a source's size in characters and its collapse; ties have mean ranks; null where one of them is constant."""
    per = _docs(spark, sf).select("source", "n_chars", T.exact_key("text").alias("k")).groupBy("source").agg(F.sum("n_chars").alias("n"), (F.count("*") / F.count_distinct("k")).alias("c"))
    mean = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2.0
    return per.select(mean("n").alias("rn"), mean("c").alias("rc")).agg(F.round(F.try_divide(F.covar_pop("rn", "rc"), F.stddev_pop("rn") * F.stddev_pop("rc")), 6).alias("rho"), F.count("*").alias("n"))


# Which text stands for a record, and the funnel.

JOINED = f"""a as (select conv_id, string_agg(coalesce(text, ''), ' ' order by turn) as joined from conversations group by 1),
b as (select d.doc_id, d.source as docket, d.n_chars, case when d.doc_id % 5 = 0 then 'See attached' else d.text end as body, coalesce(joined, '') as joined from documents d left join a on conv_id = doc_id),
picked as (select doc_id, docket, n_chars, case when doc_id % 5 <> 0 then {SPACE_SQL.format('body')} when joined <> '' then {SPACE_SQL.format('joined')} else '' end as text,
  case when doc_id % 5 <> 0 then 'body' when joined <> '' then 'attachment' else 'none' end as source from b)"""


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth body is replaced by a placeholder, so that its attachments, if any, stand for it."""
    body = F.when(F.col("doc_id") % 5 == 0, F.lit("See attached")).otherwise(F.col("text"))
    docs = _docs(spark, sf).select(F.col("doc_id").alias("id"), F.col("source").alias("docket"), body.alias("comment"), (F.col("n_chars") % 7).alias("duplicateComments"))
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.format_string("%08d", "turn").alias("file"), "text")
    return records.corpus(docs, turns).join(docs.select("id", "docket"), "id")


@query(f"with {JOINED} select doc_id as id, text, source from picked")
def assemble_left_join_concat(spark, sf):
    return _corpus(spark, sf).select("id", "text", "source")


def clean_sql(rows: str, text: str, keep: str) -> str:
    """Steps c1 to cleaned (keep, text_clean) over the table `rows`, rule by rule as the text functions have them."""
    gone = lambda t, p, flags="": f"regexp_replace({t}, {_sql((f'(?{flags})' if flags else '') + p)}, ' ', 'g')"
    has = lambda t, p, flags="": f"regexp_matches({t}, {_sql((f'(?{flags})' if flags else '') + p)})"
    inner = f"case when {has('t', '<comment>(.*?)</comment>', 'is')} then regexp_extract(t, '(?is)<comment>(.*?)</comment>', 1) else {gone('t', '<[^>]{1,80}>')} end"
    envelope = f"len(list_distinct(list_transform(regexp_extract_all(substr(t, 1, 600), {_sql('(?i)' + T.HEADER_FIELD)}, 1), lambda x: lower(x)))) >= 3"
    head = "substr(t, 1, 900)"
    for pattern in (T.LABEL_RUN, T.MAILBOX, T.LONG_DATE):
        head = gone(head, pattern, "i")
    return f"""c1 as (select {keep}, coalesce({text}, '') as t from {rows}),
c2 as (select {keep}, case when {has('t', T.RECEIPT, 'is')} then {inner} else t end as t from c1),
c3 as (select {keep}, substr(t, length(regexp_extract(substr(t, 1, 600), {_sql('(?is)' + T.FLAT_RECEIPT)}, 0)) + 1) as t from c2),
c4 as (select {keep}, {gone(gone('t', T.RENDER_TRAILER, 'is'), r']]>[\s]*$')} as t from c3),
c5 as (select {keep}, case when {has('t', T.BARE_RECEIPT)} and length(t) < 400 then '' else t end as t from c4),
c6 as (select {keep}, t, regexp_extract(substr(t, 1, 1500), {_sql(T.SALUTATION)}, 0) as dear from c5),
c7 as (select {keep}, case when dear <> '' and {envelope} then trim(substr(t, instr(t, dear))) else t end as t from c6),
c8 as (select {keep}, {head} || substr(t, 901) as t from c7),
cleaned as (select {keep}, trim({gone(gone(gone(gone('t', T.EMAIL), T.URL), T.DOCKET_LINE, 'i'), WS)}) as text_clean from c8)"""


@query(f"""with {JOINED}, {clean_sql('picked', 'text', 'doc_id, docket, source')}
select docket, count(*) as records, count(*) filter (source = 'none') as no_text, count(*) filter (source <> 'none' and text_clean = '') as emptied, count(*) filter (source <> 'none' and text_clean <> '') as usable from cleaned group by 1""")
def funnel_counts(spark, sf):
    return docket.funnel(_corpus(spark, sf), "docket")


@query(f"""with {KEYED}, s as (select source, case when bool_or(n_chars % 7 > 0) then sum(case when n_chars % 7 > 0 then n_chars % 7 else 1 end) end::bigint as total, count(*) filter (n_chars % 7 > 1) as populated_records,
  count(*) as records, bool_or(n_chars % 7 > 0) as field_populated, count(distinct k) as clusters from keyed group by 1)
select *, total / records as official_collapse, records / clusters as additional_collapse, total / clusters as total_collapse, 1 - (records / clusters - 1) / greatest(1e-9, total / clusters - 1) as official_share from s""")
def submissions_margin(spark, sf):
    rows = _docs(spark, sf).select("source", (F.col("n_chars") % 7).alias("dc"), T.exact_key("text").alias("k"))
    own = rows.groupBy("source").agg(*(c.alias(n) for n, c in metrics.submissions("dc").items()), F.count_distinct("k").alias("clusters"))
    return metrics.margin(own)


@query("""with l as (select length(text) as n, row_number() over (order by length(text)) - 1 as r, count(*) over () as c from documents where text <> '')
select (select count(*) from documents) as records, (select count(*) from l) as usable, (select n from l where r = c // 2) as median_chars, (select sum(n_chars % 7)::bigint from documents) as submissions, (select count(*) from documents where n_chars % 7 > 1) as with_copies""")
def corpus_summary_upper_median(spark, sf):
    """The upper median by rank: no list of all lengths is gathered."""
    docs = _docs(spark, sf).select(F.length("text").alias("n"), (F.col("n_chars") % 7).alias("dc"))
    whole = docs.agg(F.count("*").alias("records"), F.count_if(F.col("n") > 0).alias("usable"), F.sum("dc").alias("submissions"), F.count_if(F.col("dc") > 1).alias("with_copies"))
    by_length = docs.where("n > 0").groupBy("n").agg(F.count("*").alias("c"))
    up_to = by_length.select("n", F.sum("c").over(Window.orderBy("n")).alias("up_to"))
    found = up_to.join(F.broadcast(whole)).where(F.col("up_to") > F.floor(F.col("usable") / 2))
    return found.groupBy("records", "usable", "submissions", "with_copies").agg(F.min("n").alias("median_chars")).select("records", "usable", "median_chars", "submissions", "with_copies")


ENTITY_SQL = "regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
for _entity, _to in T.ENTITIES:
    ENTITY_SQL = f"replace({ENTITY_SQL}, '{_entity}', '{_to.replace(chr(39), chr(39) * 2)}')"


@query(f"select page_id, sha256({SPACE_SQL.format(ENTITY_SQL)}) as h, length({SPACE_SQL.format(ENTITY_SQL)}) as n from pages")
def html_strip(spark, sf):
    t = T.body_text("html")
    return table(spark, sf, "pages").select("page_id", F.sha2(t.cast("binary"), 256).alias("h"), F.length(t).cast("long").alias("n"))


BODIES = [
    "See attached", "Please see the attached file(s).", '"See attached letter"', "<p>see attachment</p>", "n/a", "", None, "I oppose this rule.", "My letter is attached and I also think the limit is far too high for small shops.",
    "Acme County hereby submits the attached comments. Thank you.", "Acme submits the attached data. The limit is wrong. It should be lower.", "See attached comments prepared for a broad group of schools and towns",
    "none", "Find enclosed copy of our study", "test drive",
]
_HTML_SQL = ENTITY_SQL.replace("html", "body")
_BODY_SQL = SPACE_SQL.format(_HTML_SQL)


@query(f"""with b as (select doc_id, coalesce(case when doc_id % 3 = 0 then {_dealt_sql(BODIES, 'doc_id // 3')} else text end, '') as body from documents),
t as (select doc_id, {_BODY_SQL} as b from b), q as (select doc_id, b, trim(regexp_replace(b, {_sql(f'^{T.QUOTES}|{T.QUOTES}$')}, '', 'g')) as bare from t)
select doc_id, bare = '' or regexp_matches(bare, {_sql('(?i)' + T.PLACEHOLDER)}) as placeholder,
  b <> '' and ((length(b) <= {T.POINTER_CHARS} and regexp_matches(b, {_sql('(?i)' + T.POINTER)})) or (length(b) <= {T.POINTER_MID_CHARS} and regexp_matches(substr(b, 1, {T.POINTER_MID_WINDOW}), {_sql('(?i)' + T.POINTER_MID)})
    and len(list_filter(string_split(regexp_replace(b, '([.!?])[\\s]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) <= 2)) as pointer
from q""")
def placeholder_pointer_flags(spark, sf):
    """Every third document's body is one of the short ones that the rules are about."""
    body = F.when(F.col("doc_id") % 3 == 0, _dealt(BODIES, "k")).otherwise(F.col("text"))
    rows = _docs(spark, sf).withColumn("k", F.floor(F.col("doc_id") / 3)).select("doc_id", body.alias("body"))
    return rows.select("doc_id", T.is_placeholder("body").alias("placeholder"), T.is_pointer("body").alias("pointer"))


DEBRIS = [
    "From: a To: b Sent: c Subject: d Dear Administrator Lee, ", "From: a To: b Subject: d ", "Page 1 of 1 - 0123456789abcdef - Jo Doe - Town <![CDATA[ ", '<?xml version="1.0"?><x><comment>Too high.</comment></x></fdms_submission>',
    "Write to me@host.org or http://host.org/a about Docket ID No. ABC-HQ-1 ", "Friday, January 27, 2023 10:58 AM A-AND-R-DOCKET ", "", "]]> Web file://host/Adlib/Work/1 4/4/2023", "0123456789abcdef - Jo Doe - Town",
]


@query(f"""with raw as (select doc_id, case when doc_id % 4 = 0 then {_dealt_sql(DEBRIS, 'doc_id // 4')} else '' end || case when doc_id % 8 = 0 then '' else coalesce(text, '') end as raw from documents),
{clean_sql('raw', 'raw', 'doc_id')} select doc_id, sha256(text_clean) as h, length(text_clean) as n from cleaned""")
def clean_rules(spark, sf):
    """Transport debris before the text of every fourth document, and alone in every eighth."""
    lead = F.when(F.col("doc_id") % 4 == 0, _dealt(DEBRIS, "k")).otherwise("")
    rows = _docs(spark, sf).withColumn("k", F.floor(F.col("doc_id") / 4)).select("doc_id", F.concat(lead, F.when(F.col("doc_id") % 8 == 0, "").otherwise(F.coalesce("text", F.lit("")))).alias("raw"))
    cleaned = T.clean("raw")
    return rows.select("doc_id", F.sha2(cleaned.cast("binary"), 256).alias("h"), F.length(cleaned).cast("long").alias("n"))


@query(f"select doc_id, case when t = '' then 0 else ((length(t) - length(replace(t, substr(t, 1, 30), ''))) / length(substr(t, 1, 30)))::bigint end as letters from (select doc_id, {SPACE_SQL.format('repeat(text, (1 + doc_id % 3)::int)')} as t from documents)")
def bundled_letters(spark, sf):
    """Texts repeated once to three times: how often each one's opening stands in it."""
    rows = _docs(spark, sf).select("doc_id", F.expr("repeat(text, cast(1 + doc_id % 3 as int))").alias("text"))
    return rows.select("doc_id", T.bundled("text", 30).alias("letters"))


# The near rung.

WORDS_SQL = f"regexp_extract_all({CANON.format('text')}, '[a-z0-9'']+')"
SHINGLES_SQL = f"""w as (select doc_id, {WORDS_SQL} as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as i from w where len(w) > 0))"""


@query(f"with {SHINGLES_SQL} select doc_id, count(s) as shingles from documents left join s using (doc_id) group by 1")
def shingle_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(T.shingles_of(T.words("text"))).cast("long").alias("shingles"))


@query(f"""with {SHINGLES_SQL}, n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as i, b.doc_id as j, count(*) as shared from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select i, j, shared / (x.n + y.n - shared) as jaccard from p join n x on x.doc_id = i join n y on y.doc_id = j where shared / (x.n + y.n - shared) >= {JACCARD}),
copies as (select j as id, min(i) as head from l where jaccard = 1 group by 1)
select i, j, round(jaccard, 6) as jaccard from l where i not in (select id from copies) and j not in (select id from copies) union all select head, id, 1.0 from copies""")
def near_pairs_exact_jaccard(spark, sf):
    """Links between the first documents of each set of shingles, and each further document's link to its first one."""
    pairs, classes = M.jaccard_pairs(_docs(spark, sf), "doc_id", "text", JACCARD)
    copies = classes.where("id <> head").select(F.col("head").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("jaccard"))
    return pairs.withColumn("jaccard", F.round("jaccard", 6)).unionByName(copies)


def signature_sql(shingles: str, ids: str, by: str = "") -> str:
    """From shingles (doc_id, s) and ids (doc_id): signatures, a class' first id, bands, candidates, scores and pairs within `by`."""
    both, on = (f", {by}", f" and a.{by} = b.{by}") if by else ("", "")
    minima = ", ".join(f"coalesce(min((h * {a} + {b}) % {M.MODULUS}), {M.MODULUS})" for a, b in M.coefficients(SIG))
    return f"""h as (select doc_id, ('0x' || substr(md5(s), 1, 7))::bigint as h from {shingles}),
sig as (select doc_id{both}, [{minima}] as sig from {ids} left join h using (doc_id) group by all),
alike as (select *, min(doc_id) over (partition by sig{both}) as head from sig), reps as (select * from alike where doc_id = head),
band as (select doc_id{both}, i as band, array_to_string(sig[i * {ROWS} + 1 : i * {ROWS} + {ROWS}], '-') as key from (select doc_id{both}, sig, unnest(range({BANDS})) as i from reps)),
cand as (select distinct a.doc_id as i, b.doc_id as j from band a join band b on a.band = b.band and a.key = b.key and a.doc_id < b.doc_id{on}),
scored as (select i, j, len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / {SIG} as score from cand join reps x on x.doc_id = i join reps y on y.doc_id = j),
near as (select * from scored where score >= {JACCARD}),
linked as (select i, j, score from near union all select head, doc_id, 1.0 from alike where doc_id <> head)"""


SIG_SQL = f"{SHINGLES_SQL}, {signature_sql('s', 'documents')}"


def _signed(spark, sf):
    return docket.staged(M.portable_signatures(_docs(spark, sf), "doc_id", "text", SIG), "signed")


def _points(spark, sf):
    """Signatures, each document's class and one row a class."""
    signed = _signed(spark, sf)
    alike = docket.staged(M.classes(signed), "classes")
    return signed, alike, docket.staged(signed.join(alike.where("id = head").select("id"), "id"), "points")


@query(f"with {SIG_SQL} select doc_id as id, sha256(array_to_string(sig, ' ')) as sig from sig")
def minhash_portable_sigs(spark, sf):
    joined = F.array_join(F.transform("sig", lambda x: x.cast("string")), " ")
    return M.portable_signatures(_docs(spark, sf), "doc_id", "text", SIG).select("id", F.sha2(joined.cast("binary"), 256).alias("sig"))


@query()
def minhash_exact_sigs(spark, sf):
    return M.exact_signatures(_docs(spark, sf), "doc_id", "text")


@query(f"with {SIG_SQL} select i, j from cand")
def lsh_candidates(spark, sf):
    """Candidates between classes of equal signatures."""
    return M.candidates(M.bands(_points(spark, sf)[2], BANDS, ROWS))


def _near(spark, sf):
    """Signatures with their class, and all near pairs: between classes, and from each class' first document to the others."""
    signed, alike, points = _points(spark, sf)
    copies = alike.where("id <> head").select(F.col("head").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("score"))
    pairs = M.near_pairs(points, JACCARD, BANDS, ROWS).unionByName(copies)
    return signed.join(alike.select("id", F.col("head").cast("string").alias("same")), "id"), docket.staged(pairs, "pairs")


@query(f"with {SIG_SQL} select i, j, score from linked")
def near_pairs_minhash(spark, sf):
    return _near(spark, sf)[1]


@query(f"""with recursive {SIG_SQL}, e as (select i, j from linked union select j, i from linked), r as (select i as id, i as c from e union select e.j, r.c from r join e on e.i = r.id)
select id, min(c) as component from r group by 1""")
def near_components(spark, sf):
    return connected_components(_near(spark, sf)[1], "i", "j").select(F.col("node").alias("id"), "component")


@query()
def near_complete_clusters(spark, sf):
    signed, pairs = _near(spark, sf)
    return linkage.near_clusters(signed, pairs, JACCARD)


@query()
def chain_diameter(spark, sf):
    pairs = _near(spark, sf)[1]
    found = connected_components(pairs, "i", "j").select(F.col("node").alias("id"), F.col("component").alias("cluster_id"))
    return linkage.chain_diameters(found, pairs)


# The semantic rung.


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


DOT_SQL = "p as (select a.vec_id as i, b.vec_id as j, list_inner_product(a.embedding::double[], b.embedding::double[]) as score from embeddings a join embeddings b on a.vec_id < b.vec_id)"


@query(f"with {DOT_SQL} select i, j, round(score, 4) as score from p where score >= {COSINE}")
def cosine_pairs(spark, sf):
    return linkage.cosine_pairs(_vectors(spark, sf), COSINE).withColumn("score", F.round("score", 4))


@query(f"""with {DOT_SQL}, b as (select i, j, score from p union all select j, i, score from p), r as (select *, row_number() over (partition by i order by score desc, j) as rank from b where score >= {COSINE})
select i, j, rank from r where rank <= 5""")
def cosine_topk(spark, sf):
    pairs = linkage.cosine_pairs(_vectors(spark, sf), COSINE)
    both = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "score"))
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "j"))
    return both.select("i", "j", rank.cast("long").alias("rank")).where("rank <= 5")


@query(f"""with recursive {DOT_SQL}, e as (select i, j from p where score >= {COSINE} union select j, i from p where score >= {COSINE}), r as (select i as id, i as c from e union select e.j, r.c from r join e on e.i = r.id)
select id, min(c) as component from r group by 1""")
def semantic_components(spark, sf):
    return connected_components(linkage.cosine_pairs(_vectors(spark, sf), COSINE), "i", "j").select(F.col("node").alias("id"), "component")


@query()
def semantic_complete_clusters(spark, sf):
    v = _vectors(spark, sf).withColumn("same", F.col("id").cast("string"))
    return linkage.semantic_clusters(v, docket.staged(linkage.cosine_pairs(v, COSINE), "cosines"), COSINE)


@query("""with e as (select label, i, avg(embedding[i]::double) as m from (select label, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by 1, 2),
n as (select label, sqrt(sum(m * m)) as l from e group by 1) select label, i - 1 as d, round(m / l, 6) as x from e join n using (label)""")
def mean_pool(spark, sf):
    pooled = embedding.mean_pooled(table(spark, sf, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("vec").alias("d", "x")).select("label", F.col("d").cast("long").alias("d"), F.round("x", 6).alias("x"))


@query("select vec_id as id, len(embedding) as dims, round(list_sum(embedding::double[]), 4) as total from embeddings")
def embedding_batch_contract(spark, sf):
    """Vectors as a batch job's output lines, unordered, matched again by id."""
    v = table(spark, sf, "embeddings")
    out = F.struct(F.col("vec_id").cast("string").alias("recordId"), F.struct(F.col("embedding").cast("array<double>").alias("embedding")).alias("modelOutput"))
    back = embedding.batch_output(v.select(F.to_json(out).alias("value")), v, "vec_id")
    return back.select("id", F.size("vec").cast("long").alias("dims"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("""select '{"recordId":"' || doc_id || '","modelInput":{"inputText":"' || lang || '","dimensions":1024,"normalize":true}}' as value from documents""")
def embedding_batch_input(spark, sf):
    return embedding.batch_input(_docs(spark, sf), "doc_id", "lang")


# Coverage of a numbered series.


@query("""with n as (select distinct doc_id as n from labels), g as (select n + 1 as first_missing, lead(n) over (order by n) - 1 as last_missing from n)
select first_missing, last_missing, last_missing - first_missing + 1 as length from g where last_missing >= first_missing""")
def id_gaps_islands(spark, sf):
    return coverage.gaps(table(spark, sf, "labels"), "doc_id")


@query("""with n as (select distinct doc_id as n from labels), g as (select lead(n) over (order by n) - n - 1 as l from n), h as (select coalesce(sum(l), 0)::bigint as holes, count(*) as runs, coalesce(max(l), 0) as longest, coalesce(sum(l) filter (l >= 5), 0)::bigint as in_runs from g where l > 0)
select min(n) as lo, max(n) as hi, count(*) as present, any_value(holes) as holes, any_value(runs) as runs, any_value(longest) as longest, any_value(in_runs) as in_runs, count(*) / (count(*) + any_value(holes)) as share from n, h""")
def id_density(spark, sf):
    return coverage.density(table(spark, sf, "labels"), "doc_id")


KEY_FORMS = ["raw-data/A/%s/comments/%s.json", "x/%s/%s(1).json", "x/%s/%s(12).json", "%s/%s(a).json", "x/%s/%s_attachment_3.pdf"]
_KEY_SQL = "replace(" + _dealt_sql([f.replace("%s", "A-2020-0001", 1).replace("%s", "#") for f in KEY_FORMS], "page_id") + ", '#', 'A-2020-0001-' || lpad(page_id::varchar, 4, '0'))"
_BASE_SQL = "regexp_replace(regexp_extract(key, '[^/]*$'), '\\.json$', '')"


@query(f"""with k as (select page_id, {_KEY_SQL} as key from pages), b as (select page_id, key, {_BASE_SQL} as base from k), c as (select *, regexp_replace(base, '^(.+?)\\(\\d+\\)$', '\\1') as id from b)
select page_id, id as comment_id, coalesce(try_cast(regexp_extract(base, '^.+?\\((\\d+)\\)$', 1) as bigint), 0) as copy_rank, try_cast(regexp_extract(id, '-(\\d+)$', 1) as bigint) as number,
  nullif(regexp_extract(key, '([A-Z][A-Za-z0-9_-]*-\\d{{4}}-[A-Za-z0-9-]+-\\d+)[^/]*$', 1), '') as any_id from c""")
def key_parsing(spark, sf):
    """Keys of several forms made from page ids, and both parsers of ids."""
    form = _dealt([f.replace("%s", "A-2020-0001", 1).replace("%s", "#") for f in KEY_FORMS], "page_id")
    rows = table(spark, sf, "pages").select("page_id", F.replace(form, F.lit("#"), F.concat(F.lit("A-2020-0001-"), F.lpad(F.col("page_id").cast("string"), 4, "0"))).alias("key"))
    cid = T.comment_id("key")
    return rows.select("page_id", cid.alias("comment_id"), T.copy_rank("key").alias("copy_rank"), T.sequence_number(cid).alias("number"), T.any_comment_id("key").alias("any_id"))


URLS = "u as (select regexp_extract(url, '^[a-z]*://([^/?#]*)', 1) || '(' || (page_id % 3) || ')' as key, page_id from pages)"


@query(f"""with {URLS}, i as (select regexp_replace(key, '\\(\\d+\\)$', '') as id, key, regexp_extract(key, '\\((\\d+)\\)$', 1)::bigint as rank from u)
select id, key, rank from (select *, row_number() over (partition by id order by rank desc, key) as n from i) where n = 1""")
def key_dedupe_latest_copy(spark, sf):
    host = F.regexp_extract("url", "^[a-z]*://([^/?#]*)", 1)
    return coverage.best_copies(table(spark, sf, "pages").select(F.concat(host, F.lit("("), (F.col("page_id") % 3).cast("string"), F.lit(")")).alias("key")))


@query("""with e as (select case when contains(regexp_extract(url, '[^/]*$'), '.') then lower(regexp_extract(url, '[^./]*$')) else '(none)' end as ext from pages where not ends_with(url, '/'))
select ext, count(*) as files from e group by 1 order by 2 desc, 1 limit 8""")
def extension_topk(spark, sf):
    return coverage.top_extensions(table(spark, sf, "pages"), "url")


@query("""with f as (select doc_id, 1 + doc_id % 3 as files, bool_or(true) as x from documents group by 1, 2), t as (select doc_id, 1 as texts from labels group by 1), b as (select * from f full join t using (doc_id))
select count(*) filter (files > 0) as with_binary, count(*) filter (texts > 0) as with_text, sum(files)::bigint as binary_files, sum(texts)::bigint as text_files, count(*) filter (texts is null) as unextracted,
  count(*) filter (texts is null and doc_id % 2 = 1) as unextracted_without_pdf, count(*) filter (files is null) as text_without_binary from b""")
def attachment_coverage(spark, sf):
    """Keys made from ids: one to three files a document, a PDF among the even ones, a text for each labelled one."""
    each = _docs(spark, sf).select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))).alias("k"))
    kind = F.when((F.col("doc_id") % 2 == 0) & (F.col("k") == 0), "pdf").otherwise("docx")
    binaries = each.select(F.format_string("d/A-2020-%d_attachment_%d.%s", "doc_id", "k", kind).alias("key"))
    texts = table(spark, sf, "labels").select("doc_id").distinct().select(F.format_string("t/A-2020-%d_attachment_1_extracted.txt", "doc_id").alias("key"))
    return coverage.attachment_coverage(binaries, texts)


@query("""with d as (select source, count(*) as official from documents group by 1), m as (select source, count(*) as n from documents join labels using (doc_id) group by 1)
select source, n, official, n / official as share, official - n as missing from m left join d using (source)""")
def coverage_share(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    official = docs.groupBy("source").agg(F.count("*").alias("official"))
    mirror = docs.join(table(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"))
    return coverage.mirror_share(mirror, official, "source")


@query(f"""with {KEYED}, r as (select source, count(*) / count(distinct k) as collapse from keyed group by 1), c as (select source, count(l.doc_id) / count(*) as share from documents left join labels l using (doc_id) where source <> 'src0' group by 1)
select source, collapse, coalesce(share, 1.0)::double as share, coalesce(share, 1.0) < 0.4 as partial from r left join c using (source)""")
def report_join(spark, sf):
    """Collapse beside coverage, 1 where a source has no coverage row, and whether it is too low to trust."""
    docs = _docs(spark, sf)
    r = docs.select("source", T.exact_key("text").alias("k")).groupBy("source").agg((F.count("*") / F.count_distinct("k")).alias("collapse"))
    labels = table(spark, sf, "labels").select("doc_id", F.lit(1).alias("has"))
    c = docs.where("source <> 'src0'").join(labels, "doc_id", "left").groupBy("source").agg((F.count("has") / F.count("*")).alias("share"))
    return r.join(c, "source", "left").select("source", "collapse", F.coalesce("share", F.lit(1.0)).alias("share"), (F.coalesce("share", F.lit(1.0)) < 0.4).alias("partial"))


def _xml(spark, sf):
    """Three urls make a listing's page; of every second one the rest follows."""
    entry = F.concat(F.lit("<Contents><Key>"), "url", F.lit("</Key><LastModified>2020-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit("</LastModified></Contents>"))
    page = table(spark, sf, "pages").groupBy(F.floor(F.col("page_id") / 3).alias("page")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("e")))).getField("e"), "").alias("e"))
    more = F.when(F.col("page") % 2 == 0, "true").otherwise("false")
    return page.select("page", F.concat(F.lit("<R><IsTruncated>"), more, F.lit("</IsTruncated>"), "e", F.lit("<NextContinuationToken>t"), F.col("page").cast("string"), F.lit("</NextContinuationToken></R>")).alias("xml"))


@query("select string_agg(url, ',' order by page_id) as keys, case when page_id // 3 % 2 = 0 then 't' || page_id // 3 end as next from pages group by page_id // 3")
def listing_page_parse(spark, sf):
    return records.parsed_pages(_xml(spark, sf)).select(F.array_join("keys", ",").alias("keys"), "next")


@query("select url as key, '2020-01-' || lpad((page_id % 28 + 1)::varchar, 2, '0') as last_modified from pages")
def listing_entries(spark, sf):
    return records.parsed_entries(_xml(spark, sf))


@query("select count(*) as n from pages where starts_with(url, 'https://') and ends_with(url, '.html')")
def listed_keys(spark, sf):
    return records.listed(table(spark, sf, "pages"), "https://", ".html", "url").agg(F.count("*").alias("n"))


# Labels, thresholds, samples.

PAIRED = "l as (select doc_id, quality as a, 1 - toxic as b, n_chars / 1000.0 as score from labels join documents using (doc_id))"


def _labels(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 1000.0).alias("score"))
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")).join(docs, "doc_id")


@query(f"""with {PAIRED}, c as (select count(*) filter (a = 1 and b = 1) as tp, count(*) filter (a = 0 and b = 1) as fp, count(*) filter (a = 1 and b = 0) as fn, count(*) filter (a = 0 and b = 0) as tn from l)
select *, tp / (tp + fp) as precision, tp / (tp + fn) as recall, 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) as f1 from c""")
def confusion_prf(spark, sf):
    return evaluate.confusion(_labels(spark, sf), F.col("a") == 1, F.col("b") == 1)


@query(f"""with {PAIRED}, t as (select count(*) as n, count(*) filter (a = b) as agree, sum(a) as sa, sum(b) as sb from l)
select n, agree, round((agree / n - (sa * sb + (n - sa) * (n - sb)) / (n * n)) / (1 - (sa * sb + (n - sa) * (n - sb)) / (n * n)), 9) as kappa from t""")
def kappa(spark, sf):
    return evaluate.kappa(_labels(spark, sf), "a", "b").withColumn("kappa", F.round("kappa", 9))


@query(f"with {PAIRED} select a, b, count(*) as n, a = b as same from l group by 1, 2")
def agreement_report(spark, sf):
    return _labels(spark, sf).groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("same", F.col("a") == F.col("b"))


REPEATS = 2000


@query(f"""with {PAIRED}, k as (select row_number() over (order by doc_id) - 1 as k, a, b, count(*) over () as n from l),
d as (select r, ('0x' || substr(md5('3:' || r || ':' || p), 1, 7))::bigint % (select any_value(n) from k) as k from range({REPEATS}) x(r), (select k as p from k)),
s as (select r, any_value(n) as n, count(*) filter (a = b) as agree, sum(a) as sa, sum(b) as sb from d join k using (k) group by 1),
v as (select case when sa * sb + (n - sa) * (n - sb) = n * n then 1.0 else (agree * n - (sa * sb + (n - sa) * (n - sb))) / (n * n - (sa * sb + (n - sa) * (n - sb)))::double end as v from s),
o as (select v, row_number() over (order by v) - 1 as i from v)
select round((select v from o where i = {int(0.025 * REPEATS)}), 9) as low, round((select v from o where i = {int(0.975 * REPEATS)}), 9) as high""")
def bootstrap_kappa_ci(spark, sf):
    return evaluate.bootstrap_kappa(_labels(spark, sf), "doc_id", "a", "b", REPEATS).select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


CURVE = f"{PAIRED}, c as (select score, count(*) filter (a = 1) as p, count(*) as c from l group by 1), r as (select score, sum(p) over (order by score desc) as tp, sum(c) over (order by score desc) as n from c)"


@query(f"with {CURVE} select min(score) filter (tp / n >= 0.9)::double as threshold from r")
def threshold_selection(spark, sf):
    return evaluate.select_threshold(_labels(spark, sf), "score", F.col("a") == 1, 0.9).select(F.col("threshold").cast("double"))


@query(f"""with {CURVE}, t as (select coalesce(max(score) filter (a <> 1), 0.0)::double as top_negative from l), s as (select min(score) filter (tp / n >= 0.9)::double as selected from r)
select top_negative, selected, selected - top_negative as width, (select count(*) from l where a = 1 and score::double > top_negative) as positives from t, s""")
def admissible_range(spark, sf):
    rows = _labels(spark, sf).withColumn("score", F.col("score").cast("double"))
    return evaluate.admissible_range(rows, "score", F.col("a") == 1, 0.9)


BAND_SQL = "case " + " ".join(f"when score >= {lo} and score < {hi} then '{lo:.2f}-{hi:.2f}'" for lo, hi in zip(evaluate.SCORE_CUTS, evaluate.SCORE_CUTS[1:], strict=False)) + " end"


@query(f"""with {SIG_SQL}, b as (select i, j, score, {BAND_SQL} as band from scored), r as (select *, row_number() over (partition by band order by md5('11:' || i || ':' || j)) as rank, count(*) over (partition by band) as population from b where band is not null)
select i, j, band, population from r where rank <= 20""")
def stratified_pair_sample(spark, sf):
    return _pair_sample(spark, sf).select("i", "j", "band", "population")


def _pair_sample(spark, sf):
    points = _points(spark, sf)[2]
    pairs = M.scored(M.candidates(M.bands(points, BANDS, ROWS)), points).withColumn("band", evaluate.score_band(F.col("score"))).where("band is not null")
    order = F.md5(F.concat_ws(":", F.lit("11"), F.col("i").cast("string"), F.col("j").cast("string")).cast("binary"))
    return evaluate.stratified(pairs, "band", order, 20)


@query(f"""with {KEYED}, c as (select cluster_id, count(*) as size from clustered group by 1), b as (select *, case when size < 2 then null when size <= 3 then '2-3' when size <= 10 then '4-10' when size <= 50 then '11-50' when size <= 500 then '51-500' else '501-max' end as band from c),
r as (select *, row_number() over (partition by band order by md5('17:' || cluster_id)) as rank, count(*) over (partition by band) as population from b where band is not null) select cluster_id, size, band, population from r where rank <= 6""")
def stratified_cluster_sample(spark, sf):
    return _cluster_sample(spark, sf).select("cluster_id", "size", "band", "population")


def _cluster_sample(spark, sf):
    sizes = exact_clusters(spark, sf).groupBy("cluster_id").agg(F.count("*").alias("size")).withColumn("band", evaluate.size_band(F.col("size"))).where("band is not null")
    return evaluate.stratified(sizes, "band", F.md5(F.concat_ws(":", F.lit("17"), F.col("cluster_id").cast("string")).cast("binary")), 6)


@query(f"""with {KEYED}, c as (select cluster_id, count(*) as size from clustered group by 1), b as (select *, case when size < 2 then null when size <= 3 then '2-3' when size <= 10 then '4-10' when size <= 50 then '11-50' when size <= 500 then '51-500' else '501-max' end as band from c),
r as (select *, row_number() over (partition by band order by md5('17:' || cluster_id)) as rank from b where band is not null), k as (select *, row_number() over (order by band, rank) - 1 as cluster from r where rank <= 6),
m as (select cluster, k.cluster_id, band, size, doc_id, text, row_number() over (partition by k.cluster_id order by doc_id) as place from k join (select cluster_id, doc_id from clustered) using (cluster_id) join documents using (doc_id))
select cluster, cluster_id, band, size, '' as label, string_agg(doc_id::varchar, ' ' order by place) as member_ids, string_agg(substr(text, 1, 600), '|' order by place) as members from m where place <= 3 group by all""")
def cluster_labelling_tasks(spark, sf):
    members = exact_clusters(spark, sf).join(_docs(spark, sf).select("doc_id", "text"), "doc_id").select("cluster_id", F.col("doc_id").alias("id"), "text")
    tasks = records.cluster_tasks(_cluster_sample(spark, sf), members)
    return tasks.withColumns({"member_ids": F.array_join(F.transform("member_ids", lambda x: x.cast("string")), " "), "members": F.array_join("members", "|")})


@query(f"""with {SIG_SQL}, b as (select i, j, score, {{band}} as band from scored), r as (select *, row_number() over (partition by band order by md5('11:' || i || ':' || j)) as rank from b where band is not null)
select row_number() over (order by band, rank) - 1 as pair, band, score, '' as label, i as a_id, j as b_id, x.source as a_source, y.source as b_source, x.n_chars % 7 as a_dupes, y.n_chars % 7 as b_dupes, substr(x.text, 1, 1200) as a_text, substr(y.text, 1, 1200) as b_text
from (select * from r where rank <= 20) r join documents x on x.doc_id = i join documents y on y.doc_id = j""".replace("{band}", BAND_SQL))
def pair_labelling_tasks(spark, sf):
    texts = _docs(spark, sf).select(F.col("doc_id").alias("id"), "text", "source", (F.col("n_chars") % 7).alias("duplicateComments"))
    return records.pair_tasks(_pair_sample(spark, sf).select("i", "j", "band", "score", "rank"), texts)


# Windows over long texts.

@query("""with w as (select doc_id, unnest(range(0, greatest(0, length(text) - 700) + 1, 350)) as o, text from documents), h as (select doc_id, o, regexp_matches(substr(text, o + 1, 700), '(?i)\\bof\\b') and regexp_matches(substr(text, o + 1, 700), '(?i)\\bwith\\b') as hit from w)
select doc_id, count(*) as windows, count(*) filter (hit) as response_windows, array_to_string((list(o order by o) filter (hit))[1:5], ' ') as offsets, round(count(*) filter (hit) / count(*), 6) as response_density from h group by 1""")
def response_windows(spark, sf):
    return _offsets(responses.passages(_docs(spark, sf), "doc_id", "text", commenter=r"\bof\b", act=r"\bwith\b"))


RULE_LINES = [
    "Public Comments\nComment: too high.\nResponse: the agency disagrees.\nSome commenters said so; one commenter did not.", "II. Response to Comments:\nAgency Response: adopted.\nA. Summary of Comments and Responses", "Nothing here.", None,
    "Many commenters asked for more time. After considering it, the agency declined.",
]
_RULES_SQL = f"rules as (select doc_id, coalesce({_dealt_sql(RULE_LINES, 'doc_id')}, '') || chr(10) || coalesce(text, '') as text from documents)"


def _rules(spark, sf):
    """Lines of a rule's preamble before each document's text."""
    lines = F.coalesce(_dealt(RULE_LINES, "doc_id"), F.lit(""))
    return _docs(spark, sf).select("doc_id", F.concat(lines, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))


_COUNTED = {"comment_response_pairs": (responses.RESPONSE, "im"), "comment_markers": (responses.COMMENT, "im"), "commenter_mentions": (responses.COMMENTER, "i"), "response_headings": (responses.HEADING, "im")}


@query(f"with {_RULES_SQL} select doc_id, length(text) as chars, " + ", ".join(f"len(regexp_extract_all(text, {_sql(f'(?{flags})' + pattern)})) as {name}" for name, (pattern, flags) in _COUNTED.items()) + " from rules")
def response_stats(spark, sf):
    return _rules(spark, sf).select("doc_id", *responses.counted("text"))


@query(f"""with {_RULES_SQL}, w as (select doc_id, unnest(range(0, greatest(0, length(text) - 700) + 1, 350)) as o, text from rules),
h as (select doc_id, o, regexp_matches(substr(text, o + 1, 700), {_sql('(?i)' + responses.COMMENTER)}) and regexp_matches(substr(text, o + 1, 700), {_sql('(?i)' + responses.ACT)}) as hit from w)
select doc_id, count(*) as windows, count(*) filter (hit) as response_windows, array_to_string((list(o order by o) filter (hit))[1:5], ' ') as offsets, round(count(*) filter (hit) / count(*), 6) as response_density from h group by 1""")
def response_passages(spark, sf):
    """The rule's own patterns over all windows."""
    return _offsets(responses.passages(_rules(spark, sf), "doc_id", "text"))


def _offsets(out):
    joined = F.array_join(F.transform("offsets", lambda x: x.cast("string")), " ")
    return out.select("doc_id", "windows", "response_windows", F.when(F.size("offsets") > 0, joined).alias("offsets"), F.round("response_density", 6).alias("response_density"))


SPLIT = f"w as (select doc_id, string_split({SPACE_SQL.format('text')}, ' ') as w from documents)"


@query(f"""with {SPLIT}, i as (select doc_id, w, unnest(range(greatest(1, ceil((len(w) - 320) / 260.0)::int + 1))) as i from w)
select doc_id, i, sha256(array_to_string(w[i * 260 + 1 : i * 260 + 320], ' ')) as h from i""")
def word_windows(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.posexplode(T.word_windows("text")).alias("i", "t"))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), F.sha2(F.col("t").cast("binary"), 256).alias("h"))


@query(f"""with {SPLIT}, i as (select doc_id, w, unnest(range(least(24, greatest(1, ceil(len(w) / 180.0)::int)))) as i from w) select doc_id, i, sha256(array_to_string(w[i * 180 + 1 : i * 180 + 180], ' ')) as h from i""")
def chunks(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.posexplode(T.chunks("text")).alias("i", "t"))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), F.sha2(F.col("t").cast("binary"), 256).alias("h"))


# Labels of pairs, more labellers, one label's weight.

LABEL_SQL = "case when quality = 1 and toxic = 0 then 'same' when quality = 1 then 'variant' when toxic = 0 then 'distinct' else 'unusable' end"
OTHER_SQL = "case when toxic = 0 and doc_id % 7 > 0 then 'same' when quality = 1 then 'variant' else 'distinct' end"


def _two(spark, sf):
    """(pair, machine, human): two labellers who mostly agree."""
    rows = table(spark, sf, "labels")
    return rows.select(F.col("doc_id").alias("pair"), F.expr(LABEL_SQL).alias("machine"), F.expr(OTHER_SQL).alias("human"))


@query(f"with l as (select doc_id as pair, {LABEL_SQL} as label from labels), u as (select pair, label, case when label = 'same' then 'merge' else 'keep' end as decision from l where label <> 'unusable') select decision, label, count(*) as n from u group by 1, 2")
def usable_labels_as_decisions(spark, sf):
    rows = labels.usable(_two(spark, sf).select("pair", F.col("machine").alias("label")))
    return rows.groupBy(labels.binary(F.col("label")).alias("decision"), "label").agg(F.count("*").alias("n"))


@query(f"with l as (select doc_id as pair, {LABEL_SQL} as label from labels), s as (select doc_id as pair, n_chars / 1000.0 as score from documents where doc_id % 2 = 0) select pair, label, label = 'same' as positive, round(score::double, 6) as score from s join l using (pair) where label <> 'unusable'")
def labels_join_sample(spark, sf):
    sample = table(spark, sf, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("pair"), F.round(F.col("n_chars") / 1000.0, 6).alias("score"))
    return labels.labelled(_two(spark, sf).select("pair", F.col("machine").alias("label")), sample)


MERGED = 0.40


@query(f"""with {DOT_SQL}, d as (select score >= {MERGED} as p, x.label = y.label as y from p join embeddings x on x.vec_id = i join embeddings y on y.vec_id = j where score >= {COSINE}),
c as (select count(*) filter (y and p) as tp, count(*) filter (not y and p) as fp, count(*) filter (y and not p) as fn, count(*) filter (not y and not p) as tn from d) select tp, fp, fn, tn from c""")
def merge_predicate_confusion(spark, sf):
    """The semantic rung's decisions about near vectors against whether their labels are equal."""
    v = table(spark, sf, "embeddings")
    side = lambda s: v.select(F.col("vec_id").alias(s), F.col("embedding").alias(f"v{s}"), F.col("label").alias(f"l{s}"))
    pairs = linkage.cosine_pairs(_vectors(spark, sf), COSINE).select("i", "j").join(side("i"), "i").join(side("j"), "j")
    merged = labels.merges("semantic", F.col("vi"), F.col("vj"), MERGED)
    return evaluate.confusion(pairs.withColumn("merged", merged), F.col("li") == F.col("lj"), F.col("merged")).select("tp", "fp", "fn", "tn")


_KAPPA = "case when n = 0 then null when pe = 1 then 1.0 else (agree / n - pe) / (1 - pe) end"


@query(f"""with two as (select doc_id as pair, {LABEL_SQL} as a, {OTHER_SQL} as b from labels), bin as (select pair, case when a = 'same' then 1 else 0 end as a, case when b = 'same' then 1 else 0 end as b from two),
w as (select count(*) as n, count(*) filter (a = b) as agree, (select sum(x.c * y.c) from (select a, count(*) as c from two group by 1) x join (select b, count(*) as c from two group by 1) y on x.a = y.b) / (count(*) * count(*)) as pe from two),
m as (select count(*) as n, count(*) filter (a = b) as agree, (sum(a) * sum(b) + (count(*) - sum(a)) * (count(*) - sum(b))) / (count(*) * count(*)) as pe from bin),
k as (select row_number() over (order by pair) - 1 as k, a, b from bin),
d as (select r, ('0x' || substr(md5('3:' || r || ':' || p), 1, 7))::bigint % (select count(*) from k) as k from range({REPEATS}) x(r), (select k as p from k)),
t as (select r, count(*) as n, count(*) filter (a = b) as agree, sum(a) as sa, sum(b) as sb from d join k using (k) group by 1),
v as (select case when sa * sb + (n - sa) * (n - sb) = n * n then 1.0 else (agree * n - (sa * sb + (n - sa) * (n - sb))) / (n * n - (sa * sb + (n - sa) * (n - sb)))::double end as v from t),
o as (select v, row_number() over (order by v) - 1 as i from v)
select w.n as pairs_compared, round(w.agree / w.n, 4) as raw_agreement, round((select {_KAPPA} from w), 4) as kappa, w.n - w.agree as disagreements, round(m.agree / m.n, 4) as raw_merge, round((select {_KAPPA} from m), 4) as kappa_merge,
  round((select v from o where i = {int(0.025 * REPEATS)}), 3) as low, round((select v from o where i = {int(0.975 * REPEATS)}), 3) as high, case when round((select {_KAPPA} from m), 4) < 0.6 then 'human labels only' else 'beside the precision' end as verdict from w, m""")
def judge_agreement(spark, sf):
    return labels.agreement_report(_two(spark, sf), "pair", "machine", "human", REPEATS)


@query(f"select doc_id as pair, {LABEL_SQL} as machine, {OTHER_SQL} as human from labels where {LABEL_SQL} <> {OTHER_SQL}")
def judge_disagreements(spark, sf):
    return labels.disagreements(_two(spark, sf), "pair", "machine", "human")


AGENTS_SQL = "r as (select doc_id, unnest(['A', 'B', 'C']) as agent, unnest([quality, 1 - toxic, quality * (1 - toxic)]) as label from labels)"


def _agents(spark, sf):
    each = F.explode(F.expr("array(struct('A' as agent, quality as label), struct('B' as agent, 1 - toxic as label), struct('C' as agent, quality * (1 - toxic) as label))"))
    return table(spark, sf, "labels").select("doc_id", each.alias("x")).select("doc_id", "x.agent", "x.label")


@query(f"""with {AGENTS_SQL}, c as (select x.agent as a, y.agent as b, count(*) as n, count(*) filter (x.label = y.label) as agree, sum(x.label) as sa, sum(y.label) as sb from r x join r y using (doc_id) where x.agent < y.agent group by 1, 2)
select a, b, n, agree, round(case when sa * sb + (n - sa) * (n - sb) = n * n then 1.0 else (agree / n - (sa * sb + (n - sa) * (n - sb)) / (n * n)) / (1 - (sa * sb + (n - sa) * (n - sb)) / (n * n)) end, 6) as kappa from c""")
def agent_matrix(spark, sf):
    return labels.agent_matrix(_agents(spark, sf), "doc_id", "agent", "label").withColumn("kappa", F.round("kappa", 6))


@query(f"with {AGENTS_SQL}, p as (select doc_id, min(label) = max(label) as one from r group by 1) select count(*) filter (one) as unanimous, count(*) as n from p")
def agents_unanimous(spark, sf):
    return labels.unanimous(_agents(spark, sf), "doc_id", "label")


@query("""with l as (select doc_id, quality as p, n_chars / 1000.0 as score from labels join documents using (doc_id) where doc_id % 4 = 0),
world as (select k.doc_id as r, 'left_out' as kind, x.p, x.score from l k join l x on x.doc_id <> k.doc_id union all select k.doc_id, 'flipped', case when x.doc_id = k.doc_id then 1 - x.p else x.p end, x.score from l k, l x),
by_score as (select r, kind, score, sum(p) as p, count(*) as c from world group by 1, 2, 3),
curve as (select r, kind, score, sum(p) over w as tp, sum(c) over w as n from by_score window w as (partition by r, kind order by score desc))
select r as doc_id, round(min(score) filter (kind = 'left_out' and tp / n >= 0.9), 6)::double as left_out, round(min(score) filter (kind = 'flipped' and tp / n >= 0.9), 6)::double as flipped from curve group by 1""")
def perturbed_thresholds(spark, sf):
    """The threshold without each label, and with it turned round; over every fourth document's label, a labelled set."""
    rows = _labels(spark, sf).where("doc_id % 4 = 0")
    out = labels.perturbed_thresholds(rows, "doc_id", "score", F.col("a") == 1, 0.9)
    return out.select("doc_id", F.round("left_out", 6).alias("left_out"), F.round("flipped", 6).alias("flipped"))


# One listing of everything, and what is reported of it.

LISTED_SQL = """e as (select source as docket, doc_id, 'comment' as kind, '2020-01-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') as modified, null as ext from documents union all select source, doc_id, 'comment', '2020-02-01', null from documents where doc_id % 10 = 0
  union all select source, doc_id + 100000, 'document', '2021-01-01', null from documents where doc_id % 50 = 0
  union all select source, doc_id, 'file', '2020-01-01', unnest(case when doc_id % 2 = 0 then ['pdf', 'docx'] else ['docx'] end) from documents where doc_id % 3 = 0
  union all select source, doc_id, 'text', '2020-01-01', null from documents join labels using (doc_id) where doc_id % 3 <> 1)"""


def _listing(spark, sf):
    """Keys of records, copies, documents, attachments and extracted texts, made from ids."""
    docs = _docs(spark, sf).select(F.col("source").alias("docket"), "doc_id")
    key = lambda kind, name, modified: F.struct(F.format_string(f"raw/A/{kind}/{name}", "doc_id").alias("key"), modified.alias("last_modified"))
    day = F.concat(F.lit("2020-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    rows = docs.select("docket", "doc_id", key("comments", "A-2020-0001-%d.json", day).alias("e"))
    rows = rows.unionByName(docs.where("doc_id % 10 = 0").select("docket", "doc_id", key("comments", "A-2020-0001-%d(1).json", F.lit("2020-02-01")).alias("e")))
    rows = rows.unionByName(docs.where("doc_id % 50 = 0").withColumn("doc_id", F.col("doc_id") + 100000).select("docket", "doc_id", key("documents", "A-2020-0001-%d.json", F.lit("2021-01-01")).alias("e")))
    for ext, those in (("pdf", "doc_id % 6 = 0"), ("docx", "doc_id % 3 = 0")):
        rows = rows.unionByName(docs.where(those).select("docket", "doc_id", key("comments_attachments", f"A-2020-0001-%d_attachment_1.{ext}", F.lit("2020-01-01")).alias("e")))
    texts = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id").where("doc_id % 3 <> 1")
    rows = rows.unionByName(texts.select("docket", "doc_id", key("comments_extracted_text", "A-2020-0001-%d_attachment_1_extracted.txt", F.lit("2020-01-01")).alias("e")))
    return rows.select("docket", "e.*")


@query(f"""with {LISTED_SQL}, n as (select distinct docket, doc_id as n from e where kind in ('comment', 'document')), g as (select docket, lead(n) over (partition by docket order by n) - n - 1 as l from n),
h as (select docket, sum(l) filter (l > 0) as holes, max(l) filter (l > 0) as longest, sum(l) filter (l >= 5) as in_runs from g group by 1), s as (select docket, min(n) as lo, max(n) as hi from n group by 1),
c as (select docket, count(*) as objects, count(distinct doc_id) as records, max(modified) as newest from e where kind = 'comment' group by 1), d as (select docket, count(distinct doc_id) as documents from e where kind = 'document' group by 1),
f as (select docket, doc_id, count(*) as files, count(*) filter (ext = 'pdf') as pdfs from e where kind = 'file' group by 1, 2), t as (select docket, doc_id, count(*) as texts from e where kind = 'text' group by 1, 2), b as (select * from f full join t using (docket, doc_id)),
a as (select docket, count(files) as with_file, sum(files) as files, sum(pdfs) as pdfs, sum(texts) as texts, count(texts) as with_text, count(*) filter (files > 0 and texts is null and pdfs > 0) as no_pdf_text, count(*) filter (files > 0 and texts is null and pdfs = 0) as no_other_text, count(*) filter (files is null) as no_file from b group by 1),
x as (select docket, ext, count(*) as n from e where kind = 'file' group by 1, 2), y as (select docket, string_agg(ext || ':' || n, ' ' order by n desc, ext) as kinds from x group by 1)
select docket, objects as comment_objects, records as comment_records, newest as mirror_newest_write, objects - records as duplicate_objects, coalesce(documents, 0) as documents, lo, hi, coalesce(holes, 0)::bigint as holes, coalesce(longest, 0) as longest_hole_run, coalesce(in_runs, 0)::bigint as holes_in_runs,
  coalesce(with_file, 0) as comments_with_attachment, coalesce(files, 0)::bigint as attachment_files, coalesce(pdfs, 0)::bigint as pdf_files, coalesce(texts, 0)::bigint as extracted_text_files, coalesce(with_text, 0) as comments_with_extracted_text,
  coalesce(no_pdf_text, 0) as unextracted_pdf_comments, coalesce(no_other_text, 0) as unextracted_nonpdf_only_comments, coalesce(no_file, 0) as extracted_without_binary, kinds as attachment_ext_counts, round(coalesce(holes, 0) / (hi - lo + 1), 4)::double as hole_share, round(coalesce(with_file, 0) / greatest(1, records), 4)::double as attachment_rate
from c left join d using (docket) left join s using (docket) left join h using (docket) left join a using (docket) left join y using (docket)""")
def coverage_walk(spark, sf):
    return coverage.walk(_listing(spark, sf))


@query("select distinct doc_id from documents where doc_id not in (select doc_id from labels) order by 1 limit 10")
def first_unlabelled(spark, sf):
    return coverage.first_missing(table(spark, sf, "labels"), table(spark, sf, "documents"), "doc_id")


@query(f"with {KEYED}, r as (select source, count(*) / count(distinct k) as collapse from keyed where source in ('src1', 'src2', 'src3') group by 1) select source, collapse, row_number() over (order by collapse desc, source) as place from r")
def report_by_collapse(spark, sf):
    """Named dockets only, in order of collapse; a report has a row a docket."""
    docs = records.subset(_docs(spark, sf), ["src1", "src2", "src3"], "source")
    r = docs.select("source", T.exact_key("text").alias("k")).groupBy("source").agg((F.count("*") / F.count_distinct("k")).alias("collapse"))
    return r.withColumn("place", F.row_number().over(Window.orderBy(F.desc("collapse"), "source")).cast("long"))


# All of it together.


LADDER_SQL = f"""with recursive {JOINED}, {clean_sql('picked', 'text', 'doc_id, docket, source, n_chars')},
usable as (select doc_id, docket, n_chars % 7 as dc, text_clean, {CANON.format('text_clean')} as k from cleaned where source <> 'none' and text_clean <> ''),
members as (select doc_id, docket, dc, text_clean, min(doc_id) over (partition by docket, k) as exact from usable),
heads as (select doc_id, docket, text_clean from members where doc_id = exact),
w as (select doc_id, regexp_extract_all({CANON.format('text_clean')}, '[a-z0-9'']+') as w from heads),
s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as i from w where len(w) > 0)),
{signature_sql('s', 'heads', 'docket')},
e as (select i, j from linked union select j, i from linked), r as (select i as id, i as c from e union select e.j, r.c from r join e on e.i = r.id), single as (select id, min(c) as c from r group by 1),
rungs as (select docket, exact, coalesce(c, exact) as near, dc from members left join single on id = exact),
one as (select docket, exact as cluster, count(*) as n from rungs group by 1, 2), two as (select docket, near as cluster, count(*) as n from rungs group by 1, 2),
x as (select docket, count(*) as exact_clusters, max(n) as exact_largest, sum(n) / count(*) as exact_collapse_vs_records, 100 * (1 - count(*) / sum(n)) as exact_extra_collapse_pct from one group by 1),
y as (select docket, count(*) as near_single_clusters, max(n) as near_single_largest, sum(n) / count(*) as near_single_collapse_vs_records, 100 * (1 - count(*) / sum(n)) as near_single_extra_collapse_pct from two group by 1),
t as (select docket, case when bool_or(dc > 0) then sum(case when dc > 0 then dc else 1 end) end::bigint as total, count(*) as records from members group by 1)
select docket, total, records, exact_clusters, exact_largest, round(exact_collapse_vs_records, 9) as exact_collapse_vs_records, round(exact_extra_collapse_pct, 9) as exact_extra_collapse_pct, near_single_clusters, near_single_largest,
  round(near_single_collapse_vs_records, 9) as near_single_collapse_vs_records, round(near_single_extra_collapse_pct, 9) as near_single_extra_collapse_pct from t join x using (docket) join y using (docket)"""


@query(LADDER_SQL)
def docket_ladder_single_link(spark, sf):
    """The ladder's counts, exact and single-link columns, on the cleaned corpus and with all 128 permutations."""
    out = docket.run(docket.staged(_corpus(spark, sf), "corpus"), "docket")
    both = [f"{r}_{c}" for r in ("exact", "near_single") for c in ("clusters", "largest", "collapse_vs_records", "extra_collapse_pct")]
    return out.select("docket", "total", "records", *(F.round(c, 9).alias(c) if c.endswith(("records", "pct")) else F.col(c) for c in both))


@query()
def docket_ladder(spark, sf):
    corpus = docket.staged(_corpus(spark, sf), "corpus")
    return docket.run(corpus, "docket", _vectors(spark, sf), cosine=COSINE)


@query()
def docket_ladder_json(spark, sf):
    rows = docket_ladder(spark, sf)
    return rows.select("docket", F.to_json(F.struct(*rows.columns)).alias("summary"))
