"""Queries on companies, articles, work queues and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import density, learned, merge, ranks, sentiment
from tidemark.sources import tables as T
from tidemark.sources.shared import shared_dir
from tidemark.streaming import streams

#: The subreddits that are searched, in order.
SUBREDDITS = (
    "wallstreetbets", "stocks", "investing", "StockMarket", "finance", "dividendinvesting", "pennystocks", "trading", "RobinHood", "wealthmanagement", "TechnicalAnalysis", "PersonalFinance",
    "ETFs", "MemeStocks", "ValueInvesting",
)
#: Bars of a company that documents may mention, from its first.
MENTIONED_BARS = 400
#: What stands in for the rows of a crawl: company names, messages, pages with links. {k} is a row's key.
NAMES = ["Firm {k}, Inc.", "Firm {k} Corp.", "Firm {k} Corporation", "Firm {k} Ltd.", "Firm {k} LLC", " Firm {k} ", "Inc. {k} Inc. Corp."]
MESSAGES = [
    "HTTP 429", "Too Many Requests", "got 403", "Forbidden", "404 Client Error", "Page Not Found", "code 500", "Internal Server Error", "502", "Bad Gateway", "503!", "Service Unavailable", "Read Timeout", "timed out",
    "Connection reset", "SSL: bad", "certificate expired", "status 418 teapot", "odd", "4040 connection", "port 8080 refused", "", "403 too many requests",
]
LINKED = [
    '<a href="https://twitter.com/AbC{k}">a</a><a href="https://twitter.com/AbC{k}">b</a><a href="https://twitter.com/intent/tweet">c</a>',
    "<A class=x HREF='https://www.Facebook.com/page.{k}?x=1'>a</A><a href=https://facebook.com/sharer>b</a>",
    '<a id="1" href="https://www.fedex.com/tracking{k}">a</a><a href="https://linkedin.com/in/someone">b</a><a href="https://linkedin.com/company/y-{k}">c</a>',
    '<a href="https://youtube.com/@ch{k}">a</a> <a href="https://youtube.com/user/u_{k}">b</a> <a href="https://youtube.com/watch?v=1">c</a><link href="https://twitter.com/no">',
    '<a\nhref = "https://instagram.com/i.{k}_">a</a><a href="https://twitter.com/Share{k}">b</a><a href="https://twitter.com/share?{k}">c</a>',
    "no links {k}",
]
#: The documents are invented prose, in which words of market news hardly stand: two of their frequent words join the lists.
POSITIVE, NEGATIVE = [*X.POSITIVE, "the"], [*X.NEGATIVE, "of"]
NOW = "2024-01-30 12:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def one_of(texts: list[str], key: str) -> Column:
    return F.replace(F.element_at(F.array(*map(F.lit, texts)), (F.col(key) % len(texts) + 1).cast("int")), F.lit("{k}"), F.col(key).cast("string"))


def article_top20(spark, sf_dir):
    return T.companies(spark, sf_dir).select("symbol", "name", "current_page").orderBy(F.desc("current_page"), "symbol").limit(20)


def article_histogram(spark, sf_dir):
    rows = T.companies(spark, sf_dir).where("current_page > 0")
    edges = rows.agg(F.min("current_page").alias("lo"), F.max("current_page").alias("hi"))
    bin_ = F.least(F.lit(49), F.floor(F.try_divide(50 * (F.col("current_page") - F.col("lo")), F.col("hi") - F.col("lo")))).cast("int")
    return rows.crossJoin(F.broadcast(edges)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))  # one row


def article_density(spark, sf_dir):
    """The curve over article_histogram: density of the number of articles at 200 points."""
    found = density.density(T.companies(spark, sf_dir).where("current_page > 0"), "current_page")
    return found.select("point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


def learned_sentiment(spark, sf_dir):
    """Every document scored by a model of the others, which take the sign of the next day's returns of the companies that they mention, at a made-up day."""
    docs = T.titled(spark, sf_dir)
    n = T.table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    mentions = docs.crossJoin(F.broadcast(n)).select("id", F.explode(F.array(F.col("id") % F.col("n"), F.floor(F.col("id") / len(SUBREDDITS)) % F.col("n"))).alias("ticker"), (F.col("id") % MENTIONED_BARS).alias("nth"))  # one row
    found = learned.scored(docs, labels=learned.labels_of(mentions, learned.next_returns(T.bars(spark, sf_dir))))
    return found.select("id", "fold", F.round("pos", 6).alias("pos"), F.round("neg", 6).alias("neg"))


def dup_titles(spark, sf_dir):
    return T.titled(spark, sf_dir).where("title is not null").groupBy("title").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "title").limit(10)


def dup_summary(spark, sf_dir):
    groups = T.titled(spark, sf_dir).where("title is not null").groupBy("title").agg(F.count("*").alias("n"))
    found = groups.agg(F.sum("n").alias("total"), F.count("*").alias("titles"), F.count_if(F.col("n") > 1).alias("repeated"), (F.sum("n") - F.count("*")).alias("redundant"))
    return found.withColumn("repeated_percent", F.round(100 * F.col("repeated") / F.col("titles"), 6))


def dup_rows(spark, sf_dir):
    return merge.repeats(T.titled(spark, sf_dir), "title", "id").select("id", "title", "nth")


def dup_clean(spark, sf_dir):
    """After a backup, in the shared folder, of what goes."""
    return merge.clean_repeats(T.titled(spark, sf_dir).select("id", "title"), "title", "id", f"{shared_dir(spark)}/backup-{uuid.uuid4().hex}", dry_run=False)


def domain_extract(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").select("page_id", X.domain(F.col("url")).alias("domain"))


def names_cleaned(spark, sf_dir):
    rows = T.table(spark, sf_dir, "customer")
    return rows.select("c_custkey", X.phrase(one_of(NAMES, "c_custkey")).alias("phrase"), X.ticker(F.concat("c_mktsegment", F.lit(".B."))).alias("ticker"), X.file_name(F.concat("c_name", F.lit("/x\\y"))).alias("file_name"))


def error_classify(spark, sf_dir):
    found = X.error_class(one_of(MESSAGES, "event_id"))
    return T.table(spark, sf_dir, "events").select(found.alias("x")).groupBy("x.code", "x.kind").agg(F.count("*").alias("n"))


def times_parsed(spark, sf_dir):
    """Epochs as text, of made-up and of the events' own times; texts as times, of which some can't be read."""
    text = F.element_at(F.array(F.lit("2024-02-29 23:59:59"), F.lit("2023-02-29 00:00:00"), F.lit("n/a"), F.lit(None).cast("string")), (F.col("event_id") % 4 + 1).cast("int"))
    return T.table(spark, sf_dir, "events").select(
        "event_id", X.epoch_text(1_700_000_000 + 86_399 * F.col("event_id")).alias("text"), F.to_date(X.time_or_null(text)).alias("date"),
        X.epoch_text(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("own_text"), F.to_date(X.time_or_null(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))).alias("own_date"),
    )


def model_text(spark, sf_dir):
    return T.titled(spark, sf_dir).select("id", F.md5(X.model_text(F.col("title"), F.col("content"))).alias("text_md5"))


def lexicon_sentiment(spark, sf_dir):
    pos, neg = X.lexicon_sentiment(F.col("content"), POSITIVE, NEGATIVE)
    return T.titled(spark, sf_dir).select("id", F.round(pos, 6).alias("pos"), F.round(neg, 6).alias("neg"))


def scored_articles(spark, sf_dir):
    """By the scorer that stands in for a model, on the text that a model gets."""
    found = sentiment.scored(T.titled(spark, sf_dir), sentiment.lexicon(POSITIVE, NEGATIVE))
    return found.select("id", F.round("pos", 6).alias("pos"), F.round("neg", 6).alias("neg"))


def handle_extract(spark, sf_dir):
    # found once, before the columns are made of it: Spark doesn't repeat what is dear and read more than once
    rows = T.table(spark, sf_dir, "customer").select("c_custkey", X.handles(one_of(LINKED, "c_custkey")).alias("found"))
    return rows.select("c_custkey", *[F.array_join(F.array_sort(F.col("found")[p]), ",").alias(p) for p in X.PLATFORMS], F.size("found").alias("n"))


def handle_json(spark, sf_dir):
    """As JSON and back."""
    name = F.col("c_name")
    text = X.handles_json(F.create_map(F.lit("x"), F.array(name, F.lit('q"')), F.lit("y"), F.array().cast("array<string>")))
    back = X.handles_of_json(text)
    return T.table(spark, sf_dir, "customer").select("c_custkey", text.alias("json"), back["x"][0].alias("first"), F.size(back["y"]).alias("n_y"))


def insert_ignore(spark, sf_dir):
    rows = T.table(spark, sf_dir, "documents").select(F.md5("text").alias("url"), F.col("doc_id").alias("id"))
    old = rows.where("id % 2 = 0").groupBy("url").agg(F.min("id").alias("id"))
    return merge.insert_ignore(old, rows.where("id % 2 = 1"), "url", "id")


def upsert_company(spark, sf_dir):
    rows = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_name").alias("name"), F.lit(0).alias("current_page"), F.lit(None).cast("timestamp_ntz").alias("last_updated"))
    old = rows.where("symbol % 3 <> 0").withColumn("current_page", (F.col("symbol") % 7).cast("int"))
    new = rows.where("symbol % 2 = 0 or symbol % 3 = 0").withColumn("name", F.concat("name", F.lit(" new")))
    return merge.upsert(old, new, "symbol", ["name"], "last_updated", now())


def partial_update(spark, sf_dir):
    rows = T.companies(spark, sf_dir).select("symbol", "current_page", "is_processed", F.col("last_updated").cast("timestamp_ntz").alias("last_updated"))
    changes = rows.where("symbol % 2 = 0").select("symbol", F.when(F.col("symbol") % 4 == 0, F.lit(7).cast("long")).alias("current_page"), F.lit(True).alias("is_processed"))
    return merge.partial_update(rows, changes, "symbol", "last_updated", now())


def state_presets(spark, sf_dir):
    """Some companies are marked complete, then others are reset; errors stay in both cases."""
    rows = T.companies(spark, sf_dir).select("symbol", "current_page", "is_processed", F.when(F.col("symbol") % 2 == 0, F.lit("HTTP 500")).alias("last_error"), F.lit(None).cast("timestamp_ntz").alias("last_updated"))
    done = merge.mark_complete(rows, rows.where("symbol % 4 = 1 or symbol % 4 = 2").select("symbol"), "symbol", "last_updated", now())
    return merge.reset_state(done, rows.where("symbol % 4 = 2 or symbol % 4 = 3").select("symbol"), "symbol", "last_updated", now())


def _articles(spark, sf_dir):
    return T.titled(spark, sf_dir).select("id", F.lit(None).cast("double").alias("pos"), F.lit(None).cast("double").alias("neg"))


def score_update(spark, sf_dir):
    scores = T.titled(spark, sf_dir).where("id % 2 = 0").select("id", (F.col("id") % 10 / 10).alias("pos"), (F.col("id") % 7 / 7).alias("neg"))
    found = merge.partial_update(_articles(spark, sf_dir), scores, "id")
    return found.select("id", F.round("pos", 6).alias("pos"), F.round("neg", 6).alias("neg"))


def unscored(spark, sf_dir):
    return score_update(spark, sf_dir).where("pos is null").agg(F.count("*").alias("n"))


def empty_content(spark, sf_dir):
    """Pages of the queue that have no text yet, or an empty one."""
    blank = F.when(F.col("content").isNull() & (F.col("id") % 4 == 0), F.lit("")).otherwise(F.col("content"))
    return _queue(spark, sf_dir).withColumn("content", blank).where("content is null or content = ''").orderBy("id").limit(100).select("id")


def collection_metrics(spark, sf_dir):
    pages = T.table(spark, sf_dir, "pages").select(X.domain(F.col("url")).alias("domain"))
    found = pages.agg(F.count("*").alias("articles"), F.count_distinct(F.when(F.col("domain") != "", F.col("domain"))).alias("outlets"))
    done = T.companies(spark, sf_dir).where("is_processed").agg(F.count_distinct("symbol").alias("companies"))
    return found.crossJoin(F.broadcast(done))  # one row


def media_pages(spark, sf_dir):
    """What a page of a search brings, with nothing missing: ten articles a page."""
    pages = T.table(spark, sf_dir, "pages")
    language = F.when(F.col("page_id") % 3 != 0, F.regexp_extract("html", '<html lang="([^"]*)"', 1))
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    fields = {"article_id": F.col("page_id").cast("string"), "title": title, "url": F.col("url"), "publish_date": F.lit(None).cast("string"), "media_name": X.domain(F.col("url")), "language": language}
    return pages.select((F.floor(F.col("page_id") / 10) + 1).alias("page"), *[F.coalesce(x, F.lit("")).alias(c) for c, x in fields.items()])


def company_ranges(spark, sf_dir):
    """Companies in four ranges of nearly equal size, in order of symbol."""
    counts = T.companies(spark, sf_dir).select(F.lit(1).alias("one"), F.col("symbol").alias("value"), F.lit(1).cast("long").alias("n"))
    placed = ranks.positions(counts, ["one"])
    total = placed.agg(F.sum("n").alias("total"))
    return placed.crossJoin(F.broadcast(total)).select(F.col("value").alias("symbol"), F.floor(4 * F.col("before") / F.col("total")).cast("int").alias("range"))  # one row


def merge_handles(spark, sf_dir):
    rows = T.table(spark, sf_dir, "customer")
    name = F.col("c_name")
    old, new = F.create_map(F.lit("x"), F.array(name, F.lit("b"))), F.create_map(F.lit("x"), F.array(F.lit("a"), name), F.lit("y"), F.array(F.lit("c")))
    merged = merge.merge_handles(old, new)
    return rows.select("c_custkey", F.array_join(merged["x"], ",").alias("x"), F.array_join(merged["y"], ",").alias("y"))


def resolve_outlets(spark, sf_dir):
    pages = T.table(spark, sf_dir, "pages").select(X.domain(F.col("url")).alias("domain"), "page_id")
    known = pages.groupBy("domain").agg(F.min("page_id").alias("id")).where("id % 2 = 0").select("id", "domain", F.lit("known").alias("name"))
    found = merge.resolve_or_create(known, pages.select("domain", F.col("page_id").cast("string").alias("name"), "page_id"), "domain", "name", "page_id")
    top = known.agg(F.max("id").alias("top"))
    return found.crossJoin(F.broadcast(top)).select("id", "domain", "name", (F.col("id") > F.coalesce("top", F.lit(0))).alias("is_new"))  # one row


def upsert_outlets(spark, sf_dir):
    """Outlets with handles: known ones get another name and more handles, others a new id. Handles are made up of the pages' numbers."""
    pages = T.table(spark, sf_dir, "pages").select(X.domain(F.col("url")).alias("domain"), "page_id")
    made = F.create_map(F.lit("twitter"), F.array(F.concat(F.lit("u"), F.col("page_id") % 3)), F.lit("youtube"), F.when(F.col("page_id") % 2 == 0, F.array(F.concat(F.lit("c"), F.col("page_id") % 5))).otherwise(F.array().cast("array<string>")))
    known = pages.groupBy("domain").agg(F.min("page_id").alias("id")).where("id % 2 = 0")
    known = known.select("id", "domain", F.lit("known").alias("name"), F.create_map(F.lit("twitter"), F.array(F.lit("a"), F.col("domain")), F.lit("facebook"), F.array(F.lit("f"))).alias("handles"))
    found = merge.upsert_with_handles(known, pages.select("domain", F.col("page_id").cast("string").alias("name"), made.alias("handles"), "page_id"), "domain", "name", "handles", "page_id")
    return found.select("id", "domain", "name", *[F.array_join(F.col("handles")[p], ",").alias(p) for p in ("twitter", "youtube", "facebook")])


def _queue(spark, sf_dir):
    rows = T.table(spark, sf_dir, "events")
    done = F.col("event_type") == "purchase"
    return rows.select(
        F.col("event_id").alias("id"), F.when(done, F.lit("text")).alias("content"), F.lit(None).cast("string").alias("social_data"), F.lit(None).cast("long").alias("outlet_id"), done.alias("scraped"),
        F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("last_at"), (F.col("event_id") % 5).cast("int").alias("retry"), F.lit(None).cast("string").alias("error"),
    )


def scrape_worklist(spark, sf_dir):
    due = streams.eligible(_queue(spark, sf_dir), 3, now()).where("eligible")
    return due.orderBy(F.asc_nulls_first("last_at"), "id").limit(100).select("id", "retry")


def scrape_progress(spark, sf_dir):
    q = _queue(spark, sf_dir)
    return q.agg(F.count("*").alias("total"), F.count_if("scraped").alias("scraped"), F.count_if(~F.col("scraped") & (F.col("retry") < 3)).alias("pending"), F.count_if(~F.col("scraped") & (F.col("retry") >= 3)).alias("failed"))


def _outcomes(queue):
    """Tries of all rows but every third: some succeed, some fail, some meet a rate limit."""
    return queue.where("id % 3 <> 0").select(
        "id", (F.col("id") % 4 == 0).alias("ok"), F.when(F.col("id") % 8 == 0, F.lit("body")).alias("text"), F.lit('{"x":["a"]}').alias("social"), F.col("id").alias("outlet"),
        F.when(F.col("id") % 5 != 0, F.repeat(one_of(MESSAGES, "id"), 40)).alias("message"),
    )


def scrape_update(spark, sf_dir):
    q = _queue(spark, sf_dir)
    return merge.scrape_update(q, _outcomes(q), now())


def unprocessed_queue(spark, sf_dir):
    rows = T.companies(spark, sf_dir).where(~F.col("is_processed"))
    return rows.orderBy(F.asc_nulls_first("last_updated"), "symbol").limit(50).select("symbol", "last_updated")


def _submissions(spark, sf_dir):
    """url, title, created_utc and r (symbol, keyword, subreddit): of each submission the row that came in first.

    A task is a company, a keyword (symbol, then name if it differs but for case; of more than two characters) and a
    subreddit. A submission is a document: it stands in the subreddit of its number and mentions two companies, which
    either keyword finds. Tasks run by symbol, keyword and subreddit, as listed.
    """
    companies = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), F.trim("s_name").alias("name"))
    symbol = F.col("symbol").cast("string")
    words = F.when(F.lower(symbol) == F.lower("name"), F.array(symbol)).otherwise(F.array(symbol, "name"))
    tasks = companies.select("symbol", F.posexplode(words).alias("nth", "keyword")).where(F.length("keyword") > 2)
    tasks = tasks.select("symbol", "nth", "keyword", F.posexplode(F.array(*map(F.lit, SUBREDDITS))).alias("place", "subreddit"))
    n = companies.agg(F.count("*").alias("n"))
    posts = T.table(spark, sf_dir, "documents").crossJoin(F.broadcast(n)).select(  # one row
        "doc_id", F.md5("text").alias("url"), F.substring("text", 1, 80).alias("title"), (F.col("n_chars") + 1_700_000_000).alias("created_utc"),
        (F.col("doc_id") % len(SUBREDDITS)).cast("int").alias("place"), F.explode(F.array(F.col("doc_id") % F.col("n"), F.floor(F.col("doc_id") / len(SUBREDDITS)) % F.col("n"))).alias("symbol"),
    )
    found = posts.join(tasks, ["symbol", "place"])
    return found.groupBy("url", "title", "created_utc").agg(F.min_by(F.struct("symbol", "keyword", "subreddit"), F.struct("symbol", "nth", "place", "doc_id")).alias("r"))


def submissions_dedup(spark, sf_dir):
    """Submissions found by any task, each once, newest submissions first."""
    date = F.expr("CAST(timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, 0, created_utc) AS STRING)")
    return _submissions(spark, sf_dir).select("r.*", "title", "url", "created_utc", date.alias("date")).orderBy(F.desc("created_utc"), "url", "title")


def running_distinct(spark, sf_dir):
    """How many different submissions there are after each company, in order of symbol."""
    own = _submissions(spark, sf_dir).groupBy(F.col("r.symbol").alias("symbol")).agg(F.count("*").alias("n"))
    counts = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol")).join(own, "symbol", "left")
    placed = ranks.positions(counts.select(F.lit(1).alias("one"), F.col("symbol").alias("value"), F.coalesce("n", F.lit(0)).alias("n")), ["one"])
    return placed.select(F.col("value").alias("symbol"), (F.col("before") + F.col("n")).alias("so_far"))


def _streamed(spark, sf_dir, name):
    """A table as a stream, and where a query may keep what it makes and how far it came."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    return streams.source(spark, f"{sf_dir}/{name}.parquet", T.table(spark, sf_dir, name).schema), f"{folder}/out", f"{folder}/state"


def stream_windows(spark, sf_dir):
    """Sliding sums by user over the events, as a stream that takes what is there."""
    stream, out, state = _streamed(spark, sf_dir, "events")
    found = streams.sliding_sums_of_stream(stream.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "value", out, state)
    return found.select("user_id", "day", (F.round("total", 4) + F.lit(0.0)).alias("total"), "n")


def batch_windows(spark, sf_dir):
    events = T.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.sliding_sums(events, "user_id", "value").select("user_id", "day", (F.round("total", 4) + F.lit(0.0)).alias("total"), "n")


def stream_dedup(spark, sf_dir):
    """Documents as a stream, each text once."""
    stream, out, state = _streamed(spark, sf_dir, "documents")
    return streams.first_rows_of_stream(stream.select(F.md5("text").alias("url"), F.col("doc_id").alias("id")), "url", "id", out, state)


def stream_scores(spark, sf_dir):
    """Articles as a stream, scored in micro-batches and merged into the table."""
    stream, out, state = _streamed(spark, sf_dir, "documents")
    titled = stream.select(F.col("doc_id").alias("id"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("content"))
    found = streams.scores_of_stream(_articles(spark, sf_dir), titled, sentiment.lexicon(POSITIVE, NEGATIVE), out, state)
    return found.select("id", F.round("pos", 6).alias("pos"), F.round("neg", 6).alias("neg"))


def stream_retry(spark, sf_dir):
    """Events as tries of a user's page: purchases succeed, others fail, some at a rate limit."""
    stream, out, state = _streamed(spark, sf_dir, "events")
    tries = stream.select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("nth"), (F.col("event_type") == "purchase").alias("ok"), one_of(MESSAGES, "event_id").alias("message"))
    found = streams.retries_of_stream(tries, out, state)
    return found.select("id", "retry", "error", "scraped", F.col("last_at").cast("timestamp_ntz").alias("last_at"))


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _one_of(texts: list[str], key: str) -> str:
    return f"replace(([{', '.join(map(_quoted, texts))}])[{key} % {len(texts)} + 1], '{{k}}', CAST({key} AS VARCHAR))"


def _ladder(nth: int) -> str:
    whens = " ".join(f"WHEN {' OR '.join(f'contains(lower(m), {_quoted(x)})' for x in e[0])} THEN {_quoted(e[nth])}" for e in X.ERRORS)
    rest = r"nullif(regexp_extract(m, '\b(\d{3})\b', 1), '')" if nth == 1 else _quoted(X.UNKNOWN)
    return f"CASE {whens} ELSE {rest} END"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(map(_quoted, words)) + ")"


def _handles(pattern: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(links, lambda x: regexp_extract(x, {_quoted('(?i)' + pattern)}, 1)), lambda x: x <> '')))"


_COMPANIES = """c AS (SELECT s_suppkey AS symbol, s_name AS name, coalesce(n, 0) AS current_page, s_suppkey % 3 = 0 AS is_processed,
  CASE WHEN s_suppkey % 5 <> 0 THEN CAST(DATE '2024-01-01' + CAST(s_suppkey % 28 AS INTEGER) AS DATE) END AS last_updated
  FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey)"""
_TITLED = "t AS (SELECT doc_id AS id, substring(text, 1, 80) AS title, text AS content FROM documents)"
_DOMAIN = r"replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), 'www.', '')"
_QUEUE = """q AS (SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN 'text' END AS content, CAST(NULL AS VARCHAR) AS social_data, CAST(NULL AS BIGINT) AS outlet_id, event_type = 'purchase' AS scraped,
  CASE WHEN event_id % 7 <> 0 THEN ts END AS last_at, CAST(event_id % 5 AS INTEGER) AS retry, CAST(NULL AS VARCHAR) AS error FROM events)"""
_PHRASE = "name"
for _x in X.SUFFIXES:
    _PHRASE = f"replace({_PHRASE}, {_quoted(_x)}, '')"
_LIMITED = "NOT ok AND (contains(lower(m), '429') OR contains(lower(m), 'too many requests'))"
_SHARES = ", ".join(f"round(len(list_filter(w, lambda x: x IN {_in(own)})) * 1e0 / greatest(1, len(w)), 6) AS {name}" for name, own in (("pos", POSITIVE), ("neg", NEGATIVE)))
_SCORED = f"""WITH {_TITLED}, m AS (SELECT id, substring(CASE WHEN trim(content) <> '' THEN title || ' ' || content ELSE coalesce(title, '') END, 1, 2000) AS x FROM t),
  w AS (SELECT id, regexp_split_to_array(lower(x), '[^a-z]+') AS w FROM m) SELECT id, {_SHARES} FROM w"""
_WINDOWS = """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS d, sum(value) AS v, count(*) AS n FROM events GROUP BY 1, 2)
  SELECT user_id, CAST(d + CAST(k AS INTEGER) AS DATE) AS day, round(sum(v), 4) + 0e0 AS total, sum(n)::BIGINT AS n FROM d, range(15) r(k) GROUP BY 1, 2"""
_SUBMISSIONS = f"""c AS (SELECT s_suppkey AS symbol, trim(s_name) AS name FROM supplier),
  k AS (SELECT symbol, 0 AS nth, CAST(symbol AS VARCHAR) AS keyword FROM c UNION ALL SELECT symbol, 1, name FROM c WHERE lower(name) <> lower(CAST(symbol AS VARCHAR))),
  s AS (SELECT unnest([{", ".join(map(_quoted, SUBREDDITS))}]) AS subreddit, unnest(range({len(SUBREDDITS)})) AS place),
  t AS (SELECT * FROM k, s WHERE length(keyword) > 2),
  p AS (SELECT doc_id, md5(text) AS url, substring(text, 1, 80) AS title, 1700000000 + n_chars AS created_utc, doc_id % {len(SUBREDDITS)} AS place, unnest([doc_id % n, doc_id // {len(SUBREDDITS)} % n]) AS symbol
    FROM documents, (SELECT count(*) AS n FROM supplier)),
  r AS (SELECT t.symbol, keyword, subreddit, title, url, created_utc, row_number() OVER (PARTITION BY url, title, created_utc ORDER BY t.symbol, nth, t.place, doc_id) AS rn
    FROM p JOIN t ON p.symbol = t.symbol AND p.place = t.place)"""

SQL = {
    "article_top20": f"WITH {_COMPANIES} SELECT symbol, name, current_page FROM c ORDER BY current_page DESC, symbol LIMIT 20",
    "article_histogram": f"""WITH {_COMPANIES}, e AS (SELECT min(current_page) AS lo, max(current_page) AS hi FROM c WHERE current_page > 0)
      SELECT CAST(least(49, floor(50e0 * (current_page - lo) / nullif(hi - lo, 0))) AS INTEGER) AS bin, count(*) AS n FROM c, e WHERE current_page > 0 GROUP BY 1""",
    "article_density": f"""WITH {_COMPANIES}, v AS (SELECT CAST(current_page AS DOUBLE) AS x FROM c WHERE current_page > 0),
      s AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h FROM v), b AS (SELECT (x - lo) / (hi - lo) * {density.BINS} AS place FROM v, s WHERE hi > lo),
      i AS (SELECT least(floor(place), {density.BINS - 1}) AS bin, place FROM b), w AS (SELECT bin, sum(w) AS w FROM (SELECT bin, 1 - (place - bin) AS w FROM i UNION ALL SELECT bin + 1, place - bin FROM i) GROUP BY bin),
      p AS (SELECT CAST(p AS INTEGER) AS point, lo + (hi - lo) * p / {density.POINTS - 1} AS x, lo + (hi - lo) * bin / {density.BINS} AS y, w, n, h FROM w, s, range({density.POINTS}) r(p))
      SELECT point, round(x, 6) AS x, round(sum(w * exp(-pow((x - y) / h, 2) / 2) / (n * h * sqrt(2 * pi()))), 9) AS density FROM p GROUP BY point, x""",
    "dup_titles": f"WITH {_TITLED} SELECT title, count(*) AS n FROM t WHERE title IS NOT NULL GROUP BY title HAVING count(*) > 1 ORDER BY n DESC, title LIMIT 10",
    "dup_summary": f"""WITH {_TITLED}, g AS (SELECT title, count(*) AS n FROM t WHERE title IS NOT NULL GROUP BY title)
      SELECT sum(n)::BIGINT AS total, count(*) AS titles, count_if(n > 1)::BIGINT AS repeated, (sum(n) - count(*))::BIGINT AS redundant, round(100e0 * count_if(n > 1) / count(*), 6) AS repeated_percent FROM g""",
    "dup_rows": f"WITH {_TITLED}, r AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY id) AS rn FROM t WHERE title IS NOT NULL) SELECT id, title, CAST(rn AS INTEGER) AS nth FROM r WHERE rn > 1",
    "dup_clean": f"WITH {_TITLED}, r AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY id) AS rn FROM t) SELECT id, title FROM r WHERE rn = 1 OR title IS NULL",
    "domain_extract": f"SELECT page_id, {_DOMAIN} AS domain FROM pages",
    "names_cleaned": f"""WITH n AS (SELECT *, {_one_of(NAMES, "c_custkey")} AS name FROM customer)
      SELECT c_custkey, '"' || {_PHRASE} || '" AND language:en' AS phrase, replace(c_mktsegment || '.B.', '.', '-') AS ticker, translate(c_name || '/x\\y', '/\\', '__') AS file_name FROM n""",
    "error_classify": f"WITH e AS (SELECT {_one_of(MESSAGES, 'event_id')} AS m FROM events) SELECT {_ladder(1)} AS code, {_ladder(2)} AS kind, count(*) AS n FROM e GROUP BY 1, 2",
    "times_parsed": """SELECT event_id, strftime(make_timestamp((1700000000 + 86399 * event_id) * 1000000), '%Y-%m-%d %H:%M:%S') AS text,
      CAST(try_strptime((['2024-02-29 23:59:59', '2023-02-29 00:00:00', 'n/a', NULL])[event_id % 4 + 1], '%Y-%m-%d %H:%M:%S') AS DATE) AS date,
      strftime(ts, '%Y-%m-%d %H:%M:%S') AS own_text, CAST(ts AS DATE) AS own_date FROM events""",
    "model_text": f"WITH {_TITLED} SELECT id, md5(substring(CASE WHEN trim(content) <> '' THEN title || ' ' || content ELSE title END, 1, 2000)) AS text_md5 FROM t",
    "lexicon_sentiment": f"WITH {_TITLED}, w AS (SELECT id, regexp_split_to_array(lower(content), '[^a-z]+') AS w FROM t) SELECT id, {_SHARES} FROM w",
    "scored_articles": _SCORED,
    "stream_scores": _SCORED,
    "handle_extract": f"""WITH h AS (SELECT c_custkey, list_filter(list_transform(regexp_extract_all({_one_of(LINKED, "c_custkey")}, {_quoted(X.LINK)}, 1), lambda x: trim(x, '''"')),
        lambda x: NOT contains(x, 'share') AND NOT contains(x, 'intent')) AS links FROM customer),
      f AS (SELECT c_custkey, {", ".join(f"{_handles(p)} AS {k}" for k, p in X.PLATFORMS.items())} FROM h)
      SELECT c_custkey, {", ".join(f"CASE WHEN len({p}) > 0 THEN array_to_string({p}, ',') END AS {p}" for p in X.PLATFORMS)}, CAST({" + ".join(f"(len({p}) > 0)::INTEGER" for p in X.PLATFORMS)} AS INTEGER) AS n FROM f""",
    "handle_json": """SELECT c_custkey, '{"x":["' || c_name || '","q\\""],"y":[]}' AS json, c_name AS first, CAST(0 AS INTEGER) AS n_y FROM customer""",
    "insert_ignore": """WITH r AS (SELECT md5(text) AS url, doc_id AS id FROM documents), o AS (SELECT url, min(id) AS id FROM r WHERE id % 2 = 0 GROUP BY url)
      SELECT url, id FROM o UNION ALL SELECT url, min(id) FROM r WHERE id % 2 = 1 AND url NOT IN (SELECT url FROM o) GROUP BY url""",
    "upsert_company": f"""SELECT c_custkey AS symbol, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN c_name || ' new' ELSE c_name END AS name,
      CAST(CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 7 ELSE 0 END AS INTEGER) AS current_page, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN TIMESTAMP '{NOW}' END AS last_updated FROM customer""",
    "partial_update": f"""WITH {_COMPANIES} SELECT symbol, CASE WHEN symbol % 4 = 0 THEN 7 ELSE current_page END AS current_page, CASE WHEN symbol % 2 = 0 THEN true ELSE is_processed END AS is_processed,
      CASE WHEN symbol % 2 = 0 THEN TIMESTAMP '{NOW}' ELSE CAST(last_updated AS TIMESTAMP) END AS last_updated FROM c""",
    "state_presets": f"""WITH {_COMPANIES} SELECT symbol, CASE WHEN symbol % 4 IN (2, 3) THEN 0 ELSE current_page END AS current_page, CASE symbol % 4 WHEN 0 THEN is_processed WHEN 1 THEN true ELSE false END AS is_processed,
      CASE WHEN symbol % 2 = 0 THEN 'HTTP 500' END AS last_error, CASE WHEN symbol % 4 <> 0 THEN TIMESTAMP '{NOW}' END AS last_updated FROM c""",
    "score_update": "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN round(doc_id % 10 / 10e0, 6) END AS pos, CASE WHEN doc_id % 2 = 0 THEN round(doc_id % 7 / 7e0, 6) END AS neg FROM documents",
    "unscored": "SELECT count(*) FILTER (doc_id % 2 <> 0) AS n FROM documents",
    "empty_content": "WITH q AS (SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN 'text' WHEN event_id % 4 = 0 THEN '' END AS content FROM events) SELECT id FROM q WHERE content IS NULL OR content = '' ORDER BY id LIMIT 100",
    "collection_metrics": f"WITH {_COMPANIES} SELECT count(*) AS articles, count(DISTINCT nullif({_DOMAIN}, '')) AS outlets, (SELECT count(DISTINCT symbol) FROM c WHERE is_processed) AS companies FROM pages",
    "media_pages": f"""SELECT page_id // 10 + 1 AS page, CAST(page_id AS VARCHAR) AS article_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, coalesce(url, '') AS url, '' AS publish_date,
      coalesce({_DOMAIN}, '') AS media_name, CASE WHEN page_id % 3 <> 0 THEN regexp_extract(html, '<html lang="([^"]*)"', 1) ELSE '' END AS language FROM pages""",
    "company_ranges": "SELECT s_suppkey AS symbol, CAST(floor(4e0 * (row_number() OVER (ORDER BY s_suppkey) - 1) / count(*) OVER ()) AS INTEGER) AS range FROM supplier",
    "merge_handles": "SELECT c_custkey, array_to_string(list_sort(list_distinct([c_name, 'b', 'a'])), ',') AS x, 'c' AS y FROM customer",
    "resolve_outlets": f"""WITH p AS (SELECT {_DOMAIN} AS domain, page_id FROM pages), k AS (SELECT domain, min(page_id) AS id FROM p GROUP BY domain HAVING min(page_id) % 2 = 0)
      , m AS (SELECT domain, row_number() OVER (ORDER BY domain) AS r FROM (SELECT DISTINCT domain FROM p WHERE domain NOT IN (SELECT domain FROM k)))
      SELECT coalesce(k.id, (SELECT coalesce(max(id), 0) FROM k) + m.r) AS id, p.domain, CASE WHEN k.domain IS NULL THEN CAST(max(page_id) AS VARCHAR) ELSE 'known' END AS name, k.domain IS NULL AS is_new
      FROM p LEFT JOIN k USING (domain) LEFT JOIN m USING (domain) GROUP BY p.domain, k.domain, k.id, m.r""",
    "upsert_outlets": f"""WITH p AS (SELECT {_DOMAIN} AS domain, page_id FROM pages), k AS (SELECT domain, min(page_id) AS id FROM p GROUP BY domain HAVING min(page_id) % 2 = 0)
      , m AS (SELECT domain, row_number() OVER (ORDER BY domain) AS r FROM (SELECT DISTINCT domain FROM p WHERE domain NOT IN (SELECT domain FROM k))),
      g AS (SELECT domain, max(page_id) AS last, list('u' || page_id % 3) AS t, coalesce(list('c' || page_id % 5) FILTER (page_id % 2 = 0), []) AS y FROM p GROUP BY domain)
      SELECT coalesce(k.id, (SELECT coalesce(max(id), 0) FROM k) + m.r) AS id, g.domain, CAST(last AS VARCHAR) AS name,
      array_to_string(list_sort(list_distinct(CASE WHEN k.id IS NULL THEN t ELSE list_concat(t, ['a', g.domain]) END)), ',') AS twitter, array_to_string(list_sort(list_distinct(y)), ',') AS youtube,
      CASE WHEN k.id IS NOT NULL THEN 'f' END AS facebook FROM g LEFT JOIN k USING (domain) LEFT JOIN m USING (domain)""",
    "scrape_worklist": f"WITH {_QUEUE} SELECT id, retry FROM q WHERE content IS NULL AND NOT scraped AND retry < 3 AND (last_at IS NULL OR last_at < TIMESTAMP '2024-01-30 11:00:00') ORDER BY last_at NULLS FIRST, id LIMIT 100",
    "scrape_progress": f"""WITH {_QUEUE} SELECT count(*) AS total, count_if(scraped)::BIGINT AS scraped, count_if(NOT scraped AND retry < 3)::BIGINT AS pending, count_if(NOT scraped AND retry >= 3)::BIGINT AS failed FROM q""",
    "scrape_update": f"""WITH {_QUEUE}, o AS (SELECT *, id % 3 <> 0 AS tried, id % 3 <> 0 AND id % 4 = 0 AS ok, CASE WHEN id % 5 <> 0 THEN repeat({_one_of(MESSAGES, "id")}, 40) END AS m FROM q),
      s AS (SELECT *, tried AND NOT ok AND NOT coalesce({_LIMITED}, false) AS failed FROM o)
      SELECT id, CASE WHEN ok THEN (CASE WHEN id % 8 = 0 THEN 'body' ELSE '' END) ELSE content END AS content, CASE WHEN ok THEN '{{"x":["a"]}}' ELSE social_data END AS social_data, CASE WHEN ok THEN id ELSE outlet_id END AS outlet_id,
      ok OR scraped AS scraped, CASE WHEN ok OR failed THEN TIMESTAMP '{NOW}' ELSE last_at END AS last_at, CAST(CASE WHEN ok THEN 0 WHEN failed THEN retry + 1 ELSE retry END AS INTEGER) AS retry,
      CASE WHEN ok THEN NULL WHEN failed THEN substring(coalesce(m, 'Unknown error'), 1, 500) ELSE error END AS error FROM s""",
    "unprocessed_queue": f"WITH {_COMPANIES} SELECT symbol, last_updated FROM c WHERE NOT is_processed ORDER BY last_updated NULLS FIRST, symbol LIMIT 50",
    "submissions_dedup": f"""WITH {_SUBMISSIONS}
      SELECT symbol, keyword, subreddit, title, url, created_utc, strftime(TIMESTAMP '1970-01-01' + to_seconds(created_utc), '%Y-%m-%d %H:%M:%S') AS date FROM r WHERE rn = 1 ORDER BY created_utc DESC, url, title""",
    "running_distinct": f"""WITH {_SUBMISSIONS}, n AS (SELECT symbol, count(*) AS n FROM r WHERE rn = 1 GROUP BY 1)
      SELECT c.symbol, CAST(sum(coalesce(n, 0)) OVER (ORDER BY c.symbol) AS BIGINT) AS so_far FROM c LEFT JOIN n USING (symbol)""",
    "batch_windows": _WINDOWS,
    "stream_windows": _WINDOWS,
    "stream_dedup": "SELECT md5(text) AS url, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "stream_retry": f"""WITH a AS (SELECT user_id AS id, ts, event_id AS nth, event_type = 'purchase' AS ok, {_one_of(MESSAGES, "event_id")} AS m FROM events),
      b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, nth) AS i FROM (SELECT id, ts, nth, ok, m, {_LIMITED} AS limited FROM a)),
      d AS (SELECT *, coalesce(max(i) FILTER (ok) OVER (PARTITION BY id), 0) AS done FROM b)
      SELECT id, CAST(count_if(i > done AND NOT limited) AS INTEGER) AS retry, arg_max(CASE WHEN m = '' THEN 'Unknown error' ELSE m END, i) FILTER (i > done AND NOT limited) AS error, max(done) > 0 AS scraped,
      max(ts) FILTER (ok OR NOT limited) AS last_at FROM d GROUP BY id""",
}
QUERIES = {
    f.__name__: f
    for f in (
        article_top20, article_histogram, article_density, learned_sentiment, dup_titles, dup_summary, dup_rows, dup_clean, domain_extract, names_cleaned, error_classify, times_parsed, model_text, lexicon_sentiment, scored_articles, handle_extract,
        handle_json, insert_ignore, upsert_company, partial_update, state_presets, score_update, unscored, empty_content, collection_metrics, media_pages, company_ranges, merge_handles, resolve_outlets, upsert_outlets, scrape_worklist,
        scrape_progress, scrape_update, unprocessed_queue, submissions_dedup, running_distinct, batch_windows, stream_windows, stream_dedup, stream_scores, stream_retry,
    )
}
