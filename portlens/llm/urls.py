"""URL filters: allow and block rules, else logistic regression on hashed character n-grams.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path:
from there up to `?`, `#` or the end. A url that is null or has no `://` has both
empty. A rule `host/path` fits its host and all subdomains if the url's path
begins with the rule's, whose path begins with its first `/`; of the rules that
fit the longest decides (then the one with the longer host, then allow before
block). Ports and user names are part of the host, as the definition says.

The model: the n-grams of `^host$` and of `path$` (its digits as 0), of SIZES
characters, told apart by host and path, are hashed into BUCKETS; a url's
features are its different buckets, scaled to unit length. `fit` runs full
gradient descent with an L2 penalty on at most LABELLED_ROWS labelled urls (the
first by hash, null urls and labels left out, a repeated row once), gathered as
one row of arrays: the table is small by contract and the bound holds it so.
The weights, at most BUCKETS numbers, are a constant in the plan of the scan.
Nothing here leaves the JVM or shuffles pages: a page is one row of one map task,
so a host with a third of the pages is no hot key.

Nulls, empty and very long urls and repeated rows each give their row; a url
without features has the intercept alone. With no labelled rows every score is
0.5, which allows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZES = (3, 4, 5)
BUCKETS = 65536  # 16 ** 4: four hexadecimal digits of a digest
LABELLED_ROWS = 1000
ROUNDS = 200
RATE = 8.0
PENALTY = 1e-4
THRESHOLD = 0.5  # a score above it blocks

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host/path)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: The labelled urls: what a blocklist is about (gambling, adult, pills, spam, trackers, malware, warez, scams) and ordinary sites.
BLOCKED = """
http://www.casino-royale.example.com/fr/33 http://casino-bonus.example.net/de/2000.html http://play.online-casino.example.org/es/404/ http://casinowin.test/en/7246
http://best-bets.example.com/en/31 https://www.free-betting.example.net/de/12 http://sportsbets.example.org/fr/4805.html http://bet-now.test/en/100 http://free-spins.example.com/fr/33
https://poker-room.example.net/holdem http://www.poker-win.example.org/es/404/ http://slots-jackpot.test/en/7246 http://roulette-win.example.com/en/31/ http://lottery-winner.example.net/de/12
http://adult-video.example.org/en/1 https://www.adult-cams.test/en/100 http://blog.adult-dating.example.com/fr/33 http://xxx-movies.example.net/de/2000.html http://x-rated.example.org/es/404/
http://hot-xxx.test/es/88 https://porn-tube.example.com/en/31/ http://sexy-cams.example.net/de/12 http://escort-girls.example.org/fr/4805.html http://nude-pics.test/en/100
http://cheap-meds.example.com/en/60 https://www.cheap-viagra.example.net/de/2000.html http://discount-pills.example.org/es/404/ http://pills-online.test/en/7246 http://pharma-pills.example.com/en/31/
http://no-prescription.example.net/cialis http://diet-pills.example.org/fr/4805.html http://weight-loss-miracle.test/en/100 http://cheap-steroids.example.com/fr/33 http://cheap-replica-watches.example.net/de/2000.html
http://spam-links.example.org/en/300 https://www.spam-blog.test/en/7246 http://link-farm.example.com/en/31/ http://content-farm.example.net/de/12 http://seo-spam.example.org/fr/4805.html
http://farm-of-links.test/es/303 http://comment-spam.example.com/fr/33 http://spammy-directory.example.net/de/2000.html http://mass-mailer.example.org/es/404/ http://buy-backlinks.test/en/7246
http://ads-server.example.com/en/400 https://m.ad-track.example.net/de/12 http://tracker-ads.example.org/fr/4805.html http://click-track.test/en/100 http://popup-ads.example.com/fr/33
http://ads.banner-exchange.example.net/click http://tracking-pixel.example.org/es/404/ http://m.ads-click.test/en/7246 http://adserver.example.com/en/31/ http://affiliate-track.example.net/de/12
http://free-ringtones.example.org/download http://warez-crack.test/en/100 http://torrent-movies-free.example.com/fr/33 http://free-iphone.example.net/de/2000.html http://crack-serials.example.org/es/404/
http://malware-host.test/payload http://phishing-login.example.com/en/31/ http://secure-paypa1.example.net/de/12 http://bank-verify.example.org/fr/4805.html http://virus-alert.test/en/100
http://get-rich-quick.example.com/money http://easy-money.example.net/de/2000.html http://payday-loans.example.org/es/404/ http://crypto-doubler.test/en/7246 http://make-money-fast.example.com/en/31/
""".split()
ALLOWED = """
http://www.city-library.example.net/fr/33 http://library.example.org/de/2000.html https://www.university.test/es/404/ http://school.example.com/en/7246 http://museum.example.net/exhibitions
https://news.daily-herald.example.org/de/12 http://www.morning-post.test/fr/4805.html http://times.example.com/en/100 https://weather.example.net/fr/33 http://radio.example.org/es/77
http://blog.gardening.test/es/404/ https://www.cooking-recipes.example.com/en/7246 http://blog.travel-notes.example.net/en/31/ http://photography.example.org/de/12 http://hiking-trails.test/de/12
https://docs.software.example.com/en/100 http://www.opensource.example.net/fr/33 http://developer.example.org/de/2000.html http://wiki.test/es/404/ http://forum.linux.example.com/thread/88
http://www.hospital.example.net/en/31/ https://health.gov.example.org/de/12 http://clinic.test/fr/4805.html http://pharmacy-school.example.com/en/100 http://nursing.example.net/fr/60
https://www.parliament.example.org/de/2000.html http://court.test/es/404/ http://www.ministry.example.com/en/7246 http://tax-office.example.net/en/31/ http://embassy.example.org/es/80
http://www.bookshop.test/fr/4805.html https://shop.furniture.example.com/en/100 http://bakery.example.net/fr/33 http://bicycle.example.org/de/2000.html http://www.hardware-store.test/tools
http://math.example.com/en/7246 http://physics.example.net/en/31/ https://www.chemistry.example.org/de/12 http://biology.test/fr/4805.html http://history.example.com/de/302
http://www.orchestra.example.net/fr/33 http://theatre.example.org/de/2000.html https://cinema.test/es/404/ http://art-gallery.example.com/en/7246 http://m.music-lessons.example.net/piano
http://www.football-club.example.org/de/12 http://swimming.test/fr/4805.html http://chess.example.com/en/100 https://marathon.example.net/fr/33 http://m.athletics.example.org/de/402
http://m.railway.test/es/404/ https://www.airport.example.com/en/7246 http://bus.example.net/en/31/ http://harbour.example.org/de/12 http://m.maps.test/en/6
http://www.thinstone.example.com/en/100 http://m.thornton.example.net/fr/33 http://blog.tenthouse.example.org/de/2000.html http://thethree.test/es/404/ https://www.whitherand.example.com/en/5
http://nationthe.example.net/en/31/ http://m.hereand.example.org/de/12 http://www.stonethe.test/fr/4805.html http://blog.andrea.example.com/en/100 https://orthand.example.net/fr/4805.html
http://village.example.org/de/2000.html https://www.church.test/es/404/ http://charity.example.com/en/7246 http://farmers-market.example.net/en/31/ http://www.dairy-cooperative.example.org/milk
http://address-book.test/fr/4805.html http://www.roads.example.com/en/100 https://headstones.example.net/fr/33 http://betterworld.example.org/de/2000.html http://alphabet.test/letters
http://racetrack-history.example.com/en/7246 http://soundtrack.example.net/en/31/ http://www.adventure.example.org/de/12 http://winter-sports.test/fr/4805.html http://windmill.example.com/energy
http://www.tenthstreet.example.net/fr/33 http://thistleshire.example.org/de/2000.html http://blog.lionshead.test/es/404/ http://therapy-notes.example.com/en/7246 http://m.thestation.example.net/en/3896.html
http://www.anderson.example.org/de/12 http://northern.test/fr/4805.html http://thatchers.example.com/en/100 http://blog.otherworld.example.net/fr/33 http://m.southend.example.org/es/1357
http://nothing.test/es/404/ http://within.example.com/en/7246 http://www.readable.example.net/en/31/ http://thoughts.example.org/de/12 http://blog.something.test/en/782
http://monthly.example.com/en/100 http://friendly.example.net/fr/33 http://www.whose.example.org/de/2000.html http://ourselves.test/es/404/ http://m.station.example.com/en/5793
http://one.example.net/en/31/ http://two.example.org/de/12 http://a.test/fr/4805.html http://www.example.com/en/100 http://home.example.net/
about:blank mailto:someone tel:100 index.html ../images/logo.png #top /en/contact page.php
""".split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also inside other lambdas."""
    return F.transform(F.array(value), body)[0]


# ----------------------------------------------------------------- parts


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def deciding_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    fitting = []
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        entry = F.struct(F.lit(len(rule)).alias("length"), F.lit(len(name)).alias("host_length"), F.lit(verdict == "allow").alias("allows"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fitting.append(F.when(fits, entry))
    if not fitting:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    best = F.array_max(F.array(*fitting))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


# -------------------------------------------------------------- features


def _buckets(text: Column, mark: str) -> Column:
    """array<int> of the n-grams of a text, repeats included."""

    def of_size(chars: Column, n: int) -> Column:
        gram = lambda i: F.concat(F.lit(mark), *[F.get(chars, i + k) for k in range(n)])
        bucket = lambda i: F.conv(F.substring(F.md5(gram(i)), 1, 4), 16, 10).cast("int")
        return F.when(F.size(chars) >= n, F.transform(F.sequence(F.lit(0), F.size(chars) - n), bucket)).otherwise(F.array().cast("array<int>"))

    def grams(chars: Column) -> Column:
        return F.concat(*[of_size(chars, n) for n in SIZES])

    return let(F.split(text, ""), grams)


def features(host: Column, path: Column) -> Column:
    """array<int>: the different buckets of a url."""
    of_host = F.when(host != "", _buckets(F.concat(F.lit("^"), host, F.lit("$")), "h")).otherwise(F.array().cast("array<int>"))
    of_path = F.when(path != "", _buckets(F.concat(F.translate(path, "123456789", "000000000"), F.lit("$")), "p")).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(of_host, of_path))


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _total(values: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + of(x))


# ----------------------------------------------------------------- model


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, blocked) of the table above."""
    entries = [F.struct(F.lit(u).alias("url"), F.lit(b).alias("blocked")) for urls, b in ((BLOCKED, True), (ALLOWED, False)) for u in urls]
    return spark.range(1).select(F.inline(F.array(*entries)))


def fit(labelled: DataFrame, rows: int = LABELLED_ROWS, rounds: int = ROUNDS) -> tuple[float, list[float]]:
    """(intercept, a weight for each bucket) from (url, blocked)."""
    asked = labelled.select("url", F.col("blocked").cast("double").alias("y")).dropna().distinct()
    asked = asked.orderBy(F.xxhash64("url"), "url", "y").limit(rows)
    held = asked.agg(F.sort_array(F.collect_list(F.struct("url", "y"))).alias("rows"))  # at most `rows`
    examples = held.select(F.posexplode("rows").alias("i", "e")).select("i", "e.y", features(host_of(F.col("e.url")), path_of(F.col("e.url"))).alias("f"))
    # each used bucket with its examples, then each example with the places of its buckets: the matrix both ways
    used = examples.select("i", F.explode("f").alias("bucket")).groupBy("bucket").agg(F.sort_array(F.collect_list("i")).alias("examples"))
    columns = used.agg(F.sort_array(F.collect_list(F.struct("bucket", "examples"))).alias("columns"))
    places = columns.select(F.posexplode("columns").alias("k", "c")).select("k", F.explode("c.examples").alias("i"))
    places = places.groupBy("i").agg(F.sort_array(F.collect_list("k")).alias("places"))
    lines = examples.select("i", "y").join(places, "i", "left").select("i", "y", F.coalesce("places", F.array().cast("array<int>")).alias("places"))
    lines = lines.withColumn("unit", F.lit(1.0) / F.sqrt(F.greatest(F.size("places"), F.lit(1))))
    lines = lines.agg(F.sort_array(F.collect_list(F.struct("i", "y", "places", "unit"))).alias("lines"))
    both = lines.select("lines", F.lit(None).cast(columns.schema["columns"].dataType).alias("columns"))
    both = both.unionByName(columns.select(F.lit(None).cast(lines.schema["lines"].dataType).alias("lines"), "columns"))
    both = both.agg(F.first("lines", ignorenulls=True).alias("lines"), F.first("columns", ignorenulls=True).alias("columns"))
    lines_, columns_ = F.col("lines"), F.col("columns")
    n = F.greatest(F.size(lines_), F.lit(1))

    def descended(state: Column, _: Column) -> Column:
        def margin(e: Column) -> Column:
            return state["intercept"] + e["unit"] * _total(e["places"], lambda k: F.get(state["weights"], k))

        residuals = F.transform(lines_, lambda e: let((_sigmoid(margin(e)) - e["y"]) / n, lambda r: F.struct(r.alias("r"), (r * e["unit"]).alias("scaled"))))
        return let(
            residuals,
            lambda r: F.struct(
                (state["intercept"] - RATE * _total(r, lambda x: x["r"])).alias("intercept"),
                F.zip_with(state["weights"], columns_, lambda w, c: w * (1 - RATE * PENALTY) - RATE * _total(c["examples"], lambda i: F.get(r, i)["scaled"])).alias("weights"),
            ),
        )

    start = F.struct(F.lit(0.0).alias("intercept"), F.transform(columns_, lambda c: F.lit(0.0)).alias("weights"))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, descended)
    fitted = both.filter(F.size(lines_) > 0).select(state.alias("s"), columns_["bucket"].alias("buckets")).first()
    weights = [0.0] * BUCKETS
    if fitted is None:
        return 0.0, weights
    for bucket, weight in zip(fitted["buckets"], fitted["s"]["weights"], strict=True):
        weights[bucket] = weight
    return fitted["s"]["intercept"], weights


def score(host: Column, path: Column, model: tuple[float, list[float]]) -> Column:
    """Probability that the url is to be blocked."""
    intercept, weights = model
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to a constant
    return let(features(host, path), lambda f: _sigmoid(F.lit(intercept) + _total(f, lambda b: F.get(table, b)) / F.sqrt(F.greatest(F.size(f), F.lit(1)))))


def judge(pages: DataFrame, model: tuple[float, list[float]], rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's), one row for each row of `pages`."""
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumns({"decided": deciding_rule(F.col("host"), F.col("path"), rules), "score": score(F.col("host"), F.col("path"), model)})
    by_model = F.when(F.col("score") > THRESHOLD, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("decided.rule").alias("rule"), F.coalesce("decided.verdict", by_model).alias("verdict"), "score")


def judge_sql(pages: str = "pages") -> str:
    """DuckDB SQL for page_id, host, path, rule, verdict: trains the model too, by a recursive table of weights."""
    labelled = ", ".join(f"('{u}', {b})" for urls, b in ((BLOCKED, 1.0), (ALLOWED, 0.0)) for u in urls)
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
    parts = lambda source, keys: f"""SELECT {keys},
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM {source}"""  # noqa: E731
    grams = " UNION ALL ".join(
        f"SELECT DISTINCT host, path, '{mark}' || substr({text}, i::BIGINT, {n}) AS gram FROM marked, range(1, length({text}) - {n - 2}) r(i) WHERE {column} <> ''"
        for mark, text, column in (("h", "of_host", "host"), ("p", "of_path", "path"))
        for n in SIZES
    )
    return f"""
WITH RECURSIVE labelled(url, y) AS (VALUES {labelled}),
examples AS ({parts('labelled', 'y')}),
page_parts AS ({parts(pages, 'page_id')}),
marked AS (
  SELECT host, path, '^' || host || '$' AS of_host, translate(path, '123456789', '000000000') || '$' AS of_path
  FROM (SELECT DISTINCT host, path FROM (SELECT host, path FROM examples UNION ALL SELECT host, path FROM page_parts))),
grams AS ({grams}),
buckets AS (SELECT DISTINCT host, path, ('0x' || substr(md5(gram), 1, 4))::INT AS bucket FROM grams),
units AS (SELECT host, path, 1 / sqrt(count(*)) AS unit FROM buckets GROUP BY host, path),
cells AS (
  SELECT host, path, bucket, unit FROM buckets JOIN units USING (host, path)
  WHERE (host, path) IN (SELECT (host, path) FROM examples)
  UNION ALL SELECT DISTINCT host, path, -1, 1.0 FROM examples),
weights(round, bucket, w) AS (
  SELECT 0, bucket, 0.0::DOUBLE FROM (SELECT DISTINCT bucket FROM cells)
  UNION ALL
  SELECT round + 1, bucket, w * (CASE WHEN bucket >= 0 THEN 1 - {RATE} * {PENALTY} ELSE 1.0 END) - {RATE} * g
  FROM weights JOIN (
    SELECT c.bucket, sum(r.residual * c.unit) AS g
    FROM cells c JOIN (
      SELECT e.host, e.path, (1 / (1 + exp(-m.margin)) - e.y) / (SELECT count(*) FROM examples) AS residual
      FROM examples e JOIN (
        SELECT c.host, c.path, sum(c.unit * v.w) AS margin FROM cells c JOIN weights v ON c.bucket = v.bucket GROUP BY c.host, c.path
      ) m ON e.host = m.host AND e.path = m.path
    ) r ON c.host = r.host AND c.path = r.path
    GROUP BY c.bucket) gradient USING (bucket)
  WHERE round < {ROUNDS}),
model AS (SELECT bucket, w FROM weights WHERE round = {ROUNDS}),
scored AS (
  SELECT host, path, sum(coalesce(w, 0) * unit) AS margin
  FROM buckets JOIN units USING (host, path) LEFT JOIN model USING (bucket) GROUP BY host, path),
rules(verdict, rule, rule_host, rule_path) AS (VALUES {rules}),
decided AS (
  SELECT DISTINCT ON (host, path) host, path, rule, verdict
  FROM (SELECT DISTINCT host, path FROM page_parts)
  JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  ORDER BY host, path, length(rule) DESC, length(rule_host) DESC, verdict)
SELECT page_id, p.host, p.path, d.rule,
  coalesce(d.verdict, CASE WHEN coalesce(s.margin, 0) + (SELECT w FROM model WHERE bucket = -1) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM page_parts p LEFT JOIN decided d ON p.host = d.host AND p.path = d.path LEFT JOIN scored s ON p.host = s.host AND p.path = s.path
"""
