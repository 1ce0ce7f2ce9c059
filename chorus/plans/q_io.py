"""Source and sink queries: each writes data derived from the driver tables to a fresh
folder under the shared checkpoint location and reads it back through the
corresponding reader, so the round trip is what is compared."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from chorus.functions import text as tx
from chorus.operators import corpus
from chorus.operators import relational as rel
from chorus.operators.ranking import position_within
from chorus.operators.reports import nested_report as nested
from chorus.plans import fixtures as fx
from chorus.plans.q_aggregate import flagship
from chorus.plans.fixtures import sql_clean, sql_tokens, with_ctes
from chorus.plans.registry import query
from chorus.session import scratch_path
from chorus.sources import files, named_texts, resumable
from chorus.sources.tables import table


@query(
    "csv_dir_union",
    with_ctes("posts") + "SELECT id, username, CASE WHEN language = 'en' THEN NULL ELSE language END AS language, tweet FROM posts",
)
def csv_dir_union(spark, sf):
    """Posts written as CSV files with two different headers (English files have no
    language column), read back as one frame combined by column name."""
    p = fx.posts(spark, sf)
    base = scratch_path(spark, "csv_dir")
    en = F.col("language") == "en"
    files.write_csv(p.filter(en).select("id", "username", "tweet"), f"{base}/en", mode="overwrite")
    files.write_csv(p.filter(~en | F.col("language").isNull()).select("id", "username", "language", "tweet"), f"{base}/other", mode="overwrite")
    got = files.read_csv_dir(spark, f"{base}/*/*.csv")
    return got.select(F.col("id").cast("long").alias("id"), "username", "language", "tweet")


@query(
    "accounts_clean",
    "SELECT c.c_name AS name, c.c_mktsegment AS party, n.n_name AS coalition, 'role' || CAST(c.c_custkey % 3 AS VARCHAR) AS role, "
    "'C' || CAST(c.c_custkey AS VARCHAR) AS username, CAST(NULL AS BIGINT) AS tweets_count "
    "FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_custkey % 7 <> 6",
)
def accounts_clean(spark, sf):
    """Account list CSV files built from the customers - each file starts with a
    sub-header line and has a link column, an extra column and rows with missing fields
    - cleaned by the account reader."""
    nat = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")  # 25 rows
    cust = table(spark, sf, "customer").join(nat, "c_nationkey")
    rows = cust.select(
        F.floor(F.col("c_custkey") / 500).cast("long").alias("part"),  # files grow with the data
        F.col("c_custkey").alias("_o"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 7 == 6, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("party"),
        F.col("n_name").alias("coalition"),
        F.concat(F.lit("role"), (F.col("c_custkey") % 3).cast("string")).alias("role"),
        F.concat(F.lit("https://twitter.com/C"), F.col("c_custkey").cast("string")).alias("link"),
        F.lit("x").alias("extra"),
    )
    heads = {"_o": -1, "name": "name line", "party": "party line", "coalition": "coalition line", "role": "role line", "link": "link line", "extra": "-"}
    sub = rows.select("part").distinct().select("part", *[F.lit(v).alias(c) for c, v in heads.items()])
    out = scratch_path(spark, "accounts")
    # one file per part, each led by its sub-header line
    (
        sub.unionByName(rows)
        .repartition("part")
        .sortWithinPartitions("part", "_o")
        .drop("_o")
        .write.option("header", True)
        .partitionBy("part")
        .csv(out)
    )
    acc = files.read_accounts(spark, out, link_column="link", url_prefix="https://twitter.com/", n_columns=5)
    return acc.select("name", "party", "coalition", "role", "username", "tweets_count")


_ROLE_CODE = {"user": "z_plus_m", "assistant": "z_minus_m", "system": "z_zero"}


@query(
    "labelled_line_parse",
    "SELECT regexp_replace(text, '[\\r\\n]', ' ', 'g') AS text, CASE role WHEN 'user' THEN 'positive' WHEN 'assistant' THEN 'negative' "
    "WHEN 'system' THEN 'neutral' ELSE 'ambiguous' END AS label FROM conversations",
)
def labelled_line_parse(spark, sf):
    """Lines ``<text>__label__<code>`` written as a text file and parsed back."""
    c = table(spark, sf, "conversations")
    code = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _ROLE_CODE.items() for x in kv]), F.col("role")), F.lit("z_amb"))
    line = F.concat(F.regexp_replace("text", r"[\r\n]", " "), F.lit(tx.LABEL_MARK), code)
    out = scratch_path(spark, "labelled")
    files.write_text_lines(c, line, out)
    return files.read_labelled_lines(spark, out)


@query(
    "text_line_sink",
    "SELECT '__label__' || role || ' ' || lower(regexp_replace(text, '[\\r\\n]', ' ', 'g')) AS value FROM conversations",
)
def text_line_sink(spark, sf):
    """Training rows written one per line without header or quoting, read back."""
    c = table(spark, sf, "conversations")
    row = tx.format_training_row("role", F.lower(F.regexp_replace("text", r"[\r\n]", " ")))
    out = scratch_path(spark, "lines")
    files.write_text_lines(c, row, out)
    return files.read_text_lines(spark, out, strip_quotes=True)


@query(
    "rows_to_named_texts",
    with_ctes("posts")
    + f"SELECT username, username || '_' || CAST(row_number() OVER (PARTITION BY username ORDER BY id) - 1 AS VARCHAR) || '.txt' AS file_name, "
    f"{sql_clean('tweet')} AS text FROM posts WHERE username IS NOT NULL",
)
def rows_to_named_texts(spark, sf):
    """One text per row named ``{user}_{i}.txt`` (i = 0-based position in the user's
    rows by id), written partitioned by user and read back."""
    p = fx.posts(spark, sf).filter(F.col("username").isNotNull()).select("id", "username", tx.clean_text("tweet").alias("text"))
    pos = position_within(p.select("username", "id"), ["username"], ["id"], out="i")  # texts stay out of the ranking
    named = p.join(pos.select("id", "i"), "id").withColumn("file_name", F.concat(F.col("username"), F.lit("_"), F.col("i").cast("string"), F.lit(".txt")))
    out = scratch_path(spark, "named")
    files.write_named_texts(named, out, key="username", name_col="file_name", text_col="text")
    back = spark.read.parquet(out)
    return back.select(F.col("username").cast("string").alias("username"), "file_name", "text")


@query(
    "incremental_by_key",
    with_ctes("posts")
    + f"SELECT username, count(*) AS n_posts, CAST(sum(length({sql_clean('tweet')})) AS BIGINT) AS n_chars FROM posts WHERE username IS NOT NULL GROUP BY username",
)
def incremental_by_key(spark, sf):
    """Per-user results computed in two resumable runs: the first stores half of the
    users, the second computes only users without a stored partial and appends."""
    p = fx.posts(spark, sf).filter(F.col("username").isNotNull()).select("username", tx.clean_text("tweet").alias("t"))
    per_user = lambda df: df.groupBy("username").agg(F.count(F.lit(1)).alias("n_posts"), F.sum(tx.text_length("t")).cast("long").alias("n_chars"))
    out = scratch_path(spark, "partials")
    first = p.filter(F.pmod(F.xxhash64("username"), F.lit(2)) == 0)
    files.write_partials(per_user(first), out, "username")
    todo = files.append_missing_keys(p, out, "username", spark)
    files.write_partials(per_user(todo), out, "username")
    back = spark.read.parquet(out)
    return back.select(F.col("username").cast("string").alias("username"), "n_posts", "n_chars")


@query(
    "text_file_per_row",
    with_ctes("posts")
    + f"SELECT username || '_' || CAST(row_number() OVER (PARTITION BY username ORDER BY id) - 1 AS VARCHAR) || '.txt' AS file_name, "
    f"{sql_clean('tweet')} AS text FROM posts WHERE username IS NOT NULL",
)
def text_file_per_row(spark, sf):
    """One file per post named ``{user}_{i}.txt`` on the shared folder, read back."""
    p = fx.posts(spark, sf).filter(F.col("username").isNotNull()).select("id", "username", "tweet")
    pos = position_within(p.select("username", "id"), ["username"], ["id"], out="i")
    name = F.concat("username", F.lit("_"), F.col("i").cast("string"), F.lit(".txt"))
    named = p.join(pos.select("id", name.alias("file_name")), "id").select("file_name", tx.clean_text("tweet").alias("text"))
    out = scratch_path(spark, "files")
    named_texts.write_text_files(named, out)
    return named_texts.read_text_files(spark, out)


@query(
    "resumed_by_key",
    with_ctes("posts")
    + f"SELECT username, count(*) AS n_posts, CAST(sum(length({sql_clean('tweet')})) AS BIGINT) AS n_chars FROM posts WHERE username IS NOT NULL GROUP BY username",
)
def resumed_by_key(spark, sf):
    """Per-user results in waves with manifests; a first run that breaks off after half of its
    waves is resumed."""
    p = fx.posts(spark, sf).filter(F.col("username").isNotNull()).select("username", "tweet")
    out, calls = scratch_path(spark, "resumable"), []

    def per_user(part):
        calls.append(1)
        if len(calls) == 3:
            raise InterruptedError("the first run ends here")
        clean = part.select("username", tx.clean_text("tweet").alias("t"))
        return clean.groupBy("username").agg(F.count(F.lit(1)).alias("n_posts"), F.sum(tx.text_length("t")).cast("long").alias("n_chars"))

    try:
        resumable.compute_missing(p, out, "username", per_user, waves=4)
    except InterruptedError:
        resumable.compute_missing(p, out, "username", per_user, waves=4)
    return resumable.read_results(spark, out)


@query("table_sink", with_ctes("posts") + "SELECT row_number() OVER (ORDER BY id) - 1 AS \"index\", id, username, language FROM posts")
def table_sink(spark, sf):
    """Relational sink that refuses to overwrite, with an index column; read back."""
    name = f"chorus_sink_{uuid.uuid4().hex[:16]}"
    path = scratch_path(spark, "table")
    df = fx.posts(spark, sf).select("id", "username", "language")
    files.write_table(df, name, path=path, order_by=["id"])
    try:
        files.write_table(df, name, path=path, order_by=["id"])
    except AnalysisException as e:
        if e.getCondition() != "TABLE_OR_VIEW_ALREADY_EXISTS":
            raise
    else:
        raise AssertionError("table sink overwrote an existing table")
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    return spark.read.parquet(path)


_SQL_STOP = (
    "WITH tok AS (SELECT DISTINCT doc_id, unnest(" + sql_tokens("text") + ") AS term FROM documents), "
    "s AS (SELECT term FROM tok GROUP BY term HAVING count(*) * 4 >= (SELECT count(*) FROM documents)) "
    "SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS pos, term AS word FROM s"
)


@query("stopword_source", _SQL_STOP)
def stopword_source(spark, sf):
    """A JSON-with-comments stop-word list built from the corpus (the terms of at least a
    quarter of the documents), written with ``//`` comments and parsed back."""
    d = table(spark, sf, "documents")
    toks = corpus.explode_tokens(d, "text", ["doc_id"])
    n = d.agg(F.count(F.lit(1))).scalar()
    df = toks.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("_n", n)
    # one small configuration file: few terms are in so many documents
    body = df.where(F.col("df") * 4 >= F.col("_n")).agg(F.to_json(F.array_sort(F.collect_list("term"))).alias("j"))
    doc = body.select(
        F.concat(F.lit("// stop words derived from the corpus\n"), F.regexp_replace("j", ",", ",  // entry\n"), F.lit("\n// end\n")).alias("value")
    )
    out = scratch_path(spark, "stopwords")
    doc.coalesce(1).write.text(out)
    return files.read_jsonc_list(spark, out)


def _sql_nested() -> str:
    from chorus.plans.registry import ORACLES

    return (
        "SELECT dim, key, CAST(row_number() OVER (PARTITION BY dim, key ORDER BY n DESC, term) - 1 AS INTEGER) AS pos, term, n FROM ("
        + ORACLES["term_counts_by_dim"] + ")"
    )


@query("nested_report", _sql_nested())
def nested_report(spark, sf):
    """The per-dimension term report as nested lists, exported as JSON and read back."""
    rep = nested(flagship(spark, sf), "dim", "key", "term", "n")
    out = scratch_path(spark, "report")
    files.write_nested_report(rep, out)
    back = spark.read.schema(rep.schema).json(out)
    flat = back.select("dim", "key", F.posexplode("items").alias("pos", "item"))
    return flat.select("dim", "key", "pos", F.col("item.text").alias("term"), F.col("item.value").alias("n"))


@query("csv_indexed", with_ctes("posts") + "SELECT id, username, language FROM posts")
def csv_indexed(spark, sf):
    """Posts written as CSV with a leading row index, read back without it."""
    p = fx.posts(spark, sf).select(F.col("id").alias("index"), "id", "username", "language")
    out = scratch_path(spark, "indexed")
    files.write_csv(p, out)
    return files.read_csv_indexed(spark, out, "index long, id long, username string, language string")


@query("json_map", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS pos, n_name AS k, 'R' || CAST(n_regionkey AS VARCHAR) AS v FROM nation")
def json_map(spark, sf):
    """A JSON object (nation -> region) in nation order, read back as ordered entries."""
    n = table(spark, sf, "nation")
    pair = F.concat(F.to_json(F.struct(F.col("n_name").alias("k"))), F.lit(""))
    entry = F.concat(F.regexp_extract(pair, r'\{"k":(.*)\}', 1), F.lit(": \"R"), F.col("n_regionkey").cast("string"), F.lit("\""))
    body = n.agg(F.array_sort(F.collect_list(F.struct("n_nationkey", entry.alias("e")))).alias("es"))  # one small file
    doc = body.select(F.concat(F.lit("{"), F.array_join(F.transform("es", lambda x: x["e"]), ",\n"), F.lit("}")).alias("value"))
    out = scratch_path(spark, "map")
    doc.coalesce(1).write.text(out)
    return files.read_json_map(spark, out)


@query("file_stem", "SELECT doc_id AS id, 'doc' || CAST(doc_id AS VARCHAR) || '.v1' AS stem FROM documents")
def file_stem(spark, sf):
    """Stems of file paths: the name without directories and the last extension."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    path = F.concat(F.lit("/data/"), "source", F.lit("/doc"), F.col("id").cast("string"), F.lit(".v1.txt"))
    return d.select("id", tx.file_stem(path).alias("stem"))
