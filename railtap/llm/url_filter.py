"""URL filters: host and path rules first, then a logistic regression on hashed character n-grams.

Rules are ``host/path-prefix`` texts.  A rule fits its host and every subdomain
of it when the path of the URL starts with the rule's; the longest fitting rule
decides.  URLs that no rule fits go to the model, trained on the small labelled
table of :func:`labelled_urls`.

Everything is Column expressions and spark.ml.  Edge cases: a null URL and one
without ``://`` have an empty host and path, which no rule fits, and pass as
``allow``: there is nothing to judge.  URLs of any length are used whole.  Rows
are independent, so repeated rows and empty tables pass through.  Columns called
``host``, ``path``, ``rule`` or ``verdict`` are replaced, others kept as they are.
"""

from __future__ import annotations

from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 18
SPLICED = 1_600
#: The probability from which a URL is unwanted: an ordinary page lost weighs more than an unwanted one kept.
LEAST = 0.7
SIZES = (3, 4, 5)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The labelled table: plain words of unwanted and of ordinary sites in several languages, and the shapes that they come in.
UNWANTED = (
    "casino poker betting bet bets slots jackpot roulette blackjack gambling gamble bingo lotto lottery sweepstakes wetten wettanbieter "
    "apuestas tragamonedas scommesse kasino pills pill viagra cialis levitra tramadol xanax steroids pharma tablets potency porn porno "
    "pornos xxx sex sexo sexy escort escorts hentai nude nudes milf fetish erotic erotik hookup camgirl camgirls adult adults naked payday "
    "loan loans forex crypto bitcoin profit profits cash earn riches millionaire replica replicas rolex counterfeit fake spam spammer "
    "spambot backlinks linkfarm linkbuilding clicks clickbait popunder popups adserver adclick ads adtrack trackers tracking malware "
    "phishing trojan spyware ransom hacked crack cracked cracks keygen warez nulled torrent torrents pirated miracle slimming "
    "weightloss fatburner detox winner winners prize prizes giveaway freebies scam").split()
ORDINARY = (
    "news zeitung journal gazette herald times library bibliothek bibliotheque biblioteca university universitaet universite "
    "universidad school schule ecole escuela museum musee museo science wissenschaft research forschung garden garten jardin recipes "
    "rezepte recettes recetas kitchen kueche cuisine bakery weather wetter meteo history geschichte histoire historia travel reisen "
    "voyage viajes railway airport city stadt ville ciudad council rathaus mairie government ministry parliament hospital klinik clinic "
    "doctor health gesundheit sante salud music musik musique theatre theater opera cinema photo gallery kunst books buch livre libro "
    "verlag publisher forum wiki docs manual support software developer linux math physics chemistry biology astronomy geology nature "
    "forest wald mountain river lake ocean animals birds dogs football tennis cycling running chess church kirche eglise charity "
    "community verein association family parents children kinder bank insurance energy water market shop store fashion furniture "
    "auto bike engineering architecture design consulting lawyer notary blog diary poetry magazine radio podcast archive map atlas "
    "dictionary translation jobs career accounts contact about help people person nation region station season reason mission session "
    "the and hand land other mother whether thread reader under often entry inner interest street order center").split()
# Words that stand beside either kind.
BESIDE = "online best my top world club web site portal free real new first big house group team place daily central".split()
_ENDS = "com net org de fr es it nl co.uk io info eu example.com example.org example.net pl".split()
_HOSTS = ("{0}.{2}", "www.{0}.{2}", "{1}-{0}.{2}", "{0}{1}.{2}", "blog.{0}-{1}.{2}", "m.{1}{0}.{2}", "{0}.{1}.{2}")
_PATHS = ("/", "", "/en/825?page=2", "/de/25", "/fr/474.html", "/es/533/", "/index.php?id=7", "/2021/04/a-day.html", "/p/{1}")


def labelled_urls() -> list[tuple[str, float]]:
    """(url, 1.0 for unwanted): every word in every host shape, the other parts in turn; ordinary hosts with an unwanted path."""
    table = []
    for label, words in ((1.0, UNWANTED), (0.0, ORDINARY)):
        for k, (word, host) in enumerate(product(words, _HOSTS)):
            parts = word, BESIDE[(5 * k + k // 11) % len(BESIDE)], _ENDS[(3 * k + k // 7) % len(_ENDS)]
            table.append((f"http{'s' * (k % 3 > 0)}://{host.format(*parts)}{_PATHS[(k + k // 5) % len(_PATHS)].format(*parts)}", label))
    for k in range(2 * len(UNWANTED)):
        host = f"www.{ORDINARY[7 * k % len(ORDINARY)]}.{_ENDS[k % len(_ENDS)]}"
        table.append((f"http://{host}/{UNWANTED[k % len(UNWANTED)]}/{k}", 1.0))
        table.append((f"http://{host}/{ORDINARY[(11 * k + 5) % len(ORDINARY)]}/{k}", 0.0))
    for k, word in enumerate(UNWANTED * 2):  # an unwanted word makes the name it is part of unwanted
        beside, end = ORDINARY[(17 * k + 3) % len(ORDINARY)], _ENDS[(5 * k + 1) % len(_ENDS)]
        table.append((f"http://{word}{beside}.{end}{_PATHS[k % len(_PATHS)].format('', beside)}", 1.0))
        table.append((f"http://www.{beside}{word}.{end}/", 1.0))
    for k in range(SPLICED):  # names that no list holds are ordinary: a beginning and an end of ordinary words
        parts = _splice(k), BESIDE[(5 * k + k // 11) % len(BESIDE)], _ENDS[(3 * k + k // 7) % len(_ENDS)]
        host, path = _HOSTS[k % len(_HOSTS)].format(*parts), _PATHS[(k + k // 5) % len(_PATHS)].format("", _splice(k + 3))
        table.append((f"https://{host}{path}", 0.0))
    return table


def _splice(k: int) -> str:
    a, b = ORDINARY[(13 * k + 1) % len(ORDINARY)], ORDINARY[(29 * k + k // len(ORDINARY) + 7) % len(ORDINARY)]
    return a[:(len(a) + 1) // 2] + b[len(b) // 2:]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def _split(df: DataFrame, url: str) -> DataFrame:
    host, path = host_and_path(F.col(url))
    return df.withColumn("host", host).withColumn("path", path)


def _grams(text: Column, mark: str) -> Column:
    """Character n-grams of the text between two marks, so that its ends count too."""
    full = F.concat(F.lit("^"), text, F.lit("$"))

    def of(n: int) -> Column:
        last = F.length(full) - n + 1
        cut = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat(F.lit(mark), F.substring(full, i, n)))
        return F.when(last >= 1, cut).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in SIZES])


def with_grams(df: DataFrame) -> DataFrame:
    return df.withColumn("grams", F.array_distinct(F.concat(_grams(F.col("host"), "h:"), _grams(F.lower("path"), "p:"))))


def train(spark: SparkSession, buckets: int = BUCKETS) -> PipelineModel:
    """The model over ``grams``; its table has some four thousand rows and its weights one number per bucket."""
    # the table travels as one text: a literal per cell would make a large plan
    lines = F.split(F.lit("\n".join(f"{y:.0f} {u}" for u, y in labelled_urls())), "\n")
    line = F.split(F.col("line"), " ")
    rows = spark.range(0, 1, 1, 1).select(F.explode(lines).alias("line")).select(line[1].alias("url"), line[0].cast("double").alias("label"))
    table = with_grams(_split(rows, "url")).select("grams", "label")
    return Pipeline(stages=[
        HashingTF(inputCol="grams", outputCol="_features", numFeatures=buckets, binary=True),
        LogisticRegression(featuresCol="_features", labelCol="label", regParam=0.002, maxIter=60, threshold=LEAST, predictionCol="_blocked",
                           probabilityCol="_probability", rawPredictionCol="_raw"),
    ]).fit(table)


def fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    return ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(slash + path))


def judge(urls: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """``urls`` with host, path, rule (null if none fits) and verdict; ``rules`` are (verdict, rule) pairs, a short list."""
    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    df = _split(urls, url)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in reversed(longest):
        rule = F.when(fits(text), F.lit(text)).otherwise(rule)
        verdict = F.when(fits(text), F.lit(said)).otherwise(verdict)
    # the model works beside the columns, so that any of its own names may be among them
    own = [F.col(f"`{c}`") for c in df.columns]
    packed = with_grams(df.select(F.struct(*own).alias("_row"), "host", "path", rule.alias("_rule"), verdict.alias("_said")))
    scored = train(urls.sparkSession).transform(packed)
    model = F.when((F.col("_blocked") > 0) & (F.col("host") != ""), "block").otherwise("allow")
    kept = [F.col("_row")[c].alias(c) for c in df.columns if c not in ("rule", "verdict")]
    return scored.select(*kept, F.col("_rule").alias("rule"), F.coalesce("_said", model).alias("verdict"))
