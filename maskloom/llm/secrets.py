"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are whole runs, of any length, of 16 or more key characters with a digit,
and what is assigned, in 8 characters or more up to a quote or white space, to a
name such as ``password`` in any case. Their features are length, changes between
kinds of characters, how much of them a dictionary covers, whether they lie in a
path, and the words beside them. The forest is trained on labelled findings and
turned into one Column expression, so scanning a table is a projection: no join, no
shuffle, no Python.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions.bytesview import bind, running_sum
from maskloom.llm.util import session, spread

KEY = "A-Za-z0-9+/_-"
RUN = rf"(?<![{KEY}])(?=[A-Za-z+/_-]*+[0-9])[{KEY}]{{16,}}+={{0,2}}"
#: Names that say so, in any case.
NAMES = "password|passwd|pwd|secret|token|api[ _-]?key|auth|bearer|credential|private|access[ _-]?key"
#: What is assigned goes on to a quote or white space, less a sentence's last marks.
VALUE = r"[^\s\"']{7,}[^\s\"'.,;:?)\]}>]"
# the first look-behind, of three characters at most, spares most places the second
GIVEN = rf"(?<=[:=][ ]?[\"']?)(?<=(?i:{NAMES})s?[\"']?[ ]?[:=][ ]?[\"']?){VALUE}"
CANDIDATE = f"{GIVEN}|{RUN}"
#: What every text with a candidate holds: quick, as few places come past the first character.
HINT = rf"[:=][ ]?[\"']?[^\s\"']{{8}}|(?<![{KEY}])(?=[A-Za-z+/_-]*+[0-9])[{KEY}]{{16}}"
#: Characters that are looked at before and after a candidate.
NEAR, AFTER = 40, 16
SECRET_WORDS = rf"(?i)(?:{NAMES})s?[^A-Za-z0-9]{{0,6}}$"
OTHER_WORDS = r"(?i)(?:commit|revision|sha|sha1|sha256|md5|checksum|digest|isbn|order|invoice|phone|tel|card|uuid|guid|version|build|page|date|file|path|ticket)[^A-Za-z0-9]{0,6}$"
#: Parts of words that names and paths are made of.
DICTIONARY = (
    "access account action admin archive article asset author auto backup base block blog book build cache card case chapter city class client "
    "cloud code color common component config content core count country course create custom data date debug default demo design detail device "
    "dist docs document draft email error event example export factory field file filter final first font form format free frame front game "
    "general global graph group guide handler help history home host html icon image import index info input install item java label language "
    "layer layout level library license light line link list local login main manager map market master media member menu message method mobile "
    "mode model module month music name network news node note number object offer office option order output package page paper part password "
    "path payment people phone photo placeholder plan player plugin point policy post power preview price print private process product profile "
    "program project public query random reader record region release remote report request resource response result review root route sample "
    "schema school script search section secret server service session setting share shop simple site size slide source space special stage "
    "standard start state static status step storage story stream string style summary support system table task team template test text theme "
    "thread ticket time title token tool topic track travel type update upload user util value vendor version video view volume web week widget "
    "window word work world year"
)
FEATURES = ("length", "changes", "distinct", "digits", "upper", "hexadecimal", "covered", "slashes", "dashes", "in_path", "secret_word", "other_word", "assigned", "issued", "longest_letters", "marks")
#: Marks with which issuers begin their keys (fixed values of public formats).
ISSUED = r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|xox[abp]-|sk_live_|sk_test_|AIza|glpat-|npm_)"
TREES, DEPTH, SEED = 24, 7, 17
CUT = 0.5


def features(token: Column, before: Column, after: Column) -> Column:
    """struct of FEATURES, all doubles."""
    size = F.greatest(F.length(token), F.lit(1)).cast("double")
    left = lambda pattern, of=token: F.length(F.regexp_replace(of, pattern, "")).cast("double")
    words = "|".join(sorted(DICTIONARY.split(), key=lambda w: (-len(w), w)))
    # a mark between neighbours of different kinds: letters by case, digits, others
    marked = F.regexp_replace(token, r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[+/_=-])(?=[A-Za-z0-9])", "~")
    yes = lambda c: c.cast("double")
    values = {
        "length": size,
        "changes": (F.length(marked) - F.length(token)) / size,
        "distinct": F.size(F.array_distinct(F.split(token, ""))) / F.least(size, F.lit(40.0)),
        "digits": 1 - left("[0-9]") / size,
        "upper": 1 - left("[A-Z]") / size,
        "hexadecimal": yes(F.rlike(token, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$"))),
        "covered": 1 - left(words, F.lower(token)) / size,
        "slashes": 1 - left("/") / size,
        "dashes": 1 - left("[_-]") / size,
        "in_path": yes(F.rlike(before, F.lit(r"[/\\.:?&%#@]$")) | F.rlike(after, F.lit(r"^[/\\?&%@]|^\.[a-z]"))),
        "secret_word": yes(F.rlike(before, F.lit(SECRET_WORDS))),
        "other_word": yes(F.rlike(before, F.lit(OTHER_WORDS))),
        "assigned": yes(F.rlike(before, F.lit(r"[:=]\s?[\"']?$"))),
        "issued": yes(F.rlike(token, F.lit(ISSUED))),
        "longest_letters": F.array_max(F.transform(F.split(token, "[^a-z]"), lambda w: F.length(w))) / size,
        "marks": 1 - left("[!@#$%^&*~?]") / size,
    }
    return F.struct(*[values[f].cast("double").alias(f) for f in FEATURES])


def candidates(text: Column) -> Column:
    """struct(all, tail). all: array of struct(at, token, gap, before, after), in
    order, ``at`` in characters from 0; a text is its candidates' gaps and tokens in
    turn, then ``tail``. Only texts with HINT have any."""
    piece = f"\\G[\\s\\S]*?({CANDIDATE})"  # a gap and its candidate; what is after the last is looked at once
    pieces = F.regexp_extract_all(text, F.lit(piece), F.lit(0))
    tokens = F.regexp_extract_all(text, F.lit(piece), F.lit(1))

    def placed(x: Column) -> Column:
        sizes = F.transform(x["pieces"], lambda p: F.length(p))
        parts = F.zip_with(x["pieces"], x["tokens"], lambda p, t: F.struct(t.alias("token"), F.left(p, F.length(p) - F.length(t)).alias("gap")))
        end = F.aggregate(sizes, F.lit(0), lambda a, n: a + n)
        return F.struct(running_sum(sizes).alias("ends"), parts.alias("parts"), F.substr(text, end + 1).alias("tail"))

    def named(x: Column) -> Column:
        nexts = F.concat(F.slice(F.transform(x["parts"], lambda p: F.left(p["gap"], F.lit(AFTER))), 2, F.size(x["parts"])), F.array(F.left(x["tail"], F.lit(AFTER))))
        where = F.zip_with(x["ends"], F.slice(nexts, 1, F.size(x["parts"])), lambda end, after: F.struct(end.alias("end"), after.alias("after")))
        one = lambda p, w: F.struct(
            (w["end"] - F.length(p["token"])).alias("at"), p["token"].alias("token"), p["gap"].alias("gap"), F.right(p["gap"], F.lit(NEAR)).alias("before"), w["after"].alias("after")
        )
        return F.struct(F.zip_with(x["parts"], where, one).alias("all"), x["tail"].alias("tail"))

    return bind(bind(F.struct(pieces.alias("pieces"), tokens.alias("tokens")), placed), named)


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """token, before, after, secret: findings drawn by rule. Half are keys as
    issuers and people write them, half what only looks so."""
    base = spark.range(0, n, 1, 1)
    draw = lambda k, m: F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(m))

    def text(k: int, alphabet: str, size: Column) -> Column:
        at = lambda i: F.pmod(F.xxhash64(F.col("id"), F.lit(k), i), F.lit(len(alphabet))).cast("int") + 1
        return F.array_join(F.transform(F.sequence(F.lit(1), size.cast("int")), lambda i: F.substring(F.lit(alphabet), at(i), F.lit(1))), "")

    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    upper, hexa = lower.upper(), digits + "abcdef"
    pick = lambda k, xs: F.element_at(F.array(*map(F.lit, xs)), (draw(k, len(xs)) + 1).cast("int"))
    words = F.array(*map(F.lit, DICTIONARY.split()))
    word = lambda k: F.element_at(words, (draw(k, len(DICTIONARY.split())) + 1).cast("int"))
    syllables = ["tion", "th", "re", "er", "an", "in", "os", "ein", "ado", "ment", "sch", "que", "ung", "eau", "lo", "mi"]
    made = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.element_at(F.array(*map(F.lit, syllables)), (F.pmod(F.xxhash64("id", F.lit(40), i), F.lit(16)) + 1).cast("int"))), "")
    secret_before = pick(1, ["password=", 'token = "', "secret: ", 'api_key="', "Authorization: Bearer ", "passwd=", "access key: ", " and the ", "", "\n"])
    plain_before = pick(2, [" and the ", "see ", "", ". ", "\n", "order ", "commit ", "card ", "phone ", "version ", "file ", "id: "])
    keys = [
        F.concat(F.lit("AKIA"), text(3, upper + "234567", F.lit(16))),
        text(4, hexa, F.lit(32) + 8 * draw(5, 5)),
        text(6, lower + upper + digits, F.lit(20) + draw(7, 30)),
        F.concat(text(8, lower + upper + digits + "+/", F.lit(32) + draw(9, 20)), F.lit("=")),
        F.concat(pick(10, ["ghp_", "sk_live_", "AIza", "xoxb-"]), text(11, lower + upper + digits, F.lit(30))),
        text(12, hexa, F.lit(16) + draw(13, 8)),
        text(14, lower + digits, F.lit(10) + draw(15, 12)),
        F.concat(made, text(57, digits, draw(58, 3) + 1)),
        made,
        F.concat(text(59, upper + lower, F.lit(3)), text(60, lower + upper + digits + "!@#$%^&*", F.lit(5) + draw(61, 12)), text(62, digits, F.lit(2))),
        F.concat(F.substring(made, 1, 6), text(63, digits, draw(64, 4) + 1), word(65)),
        F.concat(text(68, lower, F.lit(6)), text(69, digits, F.lit(2) + draw(70, 3))),
    ]
    others = [
        text(16, digits, F.lit(16) + draw(17, 4)),
        F.concat_ws("-", word(18), word(19), word(20), text(21, digits, F.lit(1) + draw(22, 4))),
        F.concat_ws("/", word(23), word(24), text(25, digits, F.lit(4)), word(26)),
        F.concat_ws("-", text(27, hexa, F.lit(8)), text(28, hexa, F.lit(4)), text(29, hexa, F.lit(4)), text(30, hexa, F.lit(4)), text(31, hexa, F.lit(12))),
        F.concat(F.lit("20"), text(32, digits, F.lit(2)), F.lit("-"), text(33, "01", F.lit(2)), F.lit("-"), text(34, "012", F.lit(2)), F.lit("-"), word(35)),
        F.concat(made, text(36, digits, F.lit(1) + draw(37, 3))),
        F.concat_ws("_", word(38), made, text(39, digits, F.lit(2))),
        F.repeat(text(41, digits, F.lit(2)), 9),
        text(42, hexa, F.lit(40)),
        F.concat(word(18), pick(66, ["", "_", "-", "."]), word(19), pick(66, ["", "_", "-", "."]), word(20)),
    ]
    choose = lambda k, xs: reduce(lambda rest, ix: F.when(draw(k, len(xs)) == ix[0], ix[1]).otherwise(rest), enumerate(xs[1:], 1), xs[0])
    is_secret = draw(50, 2) == 1
    which = draw(51, len(keys))
    rows = base.select(
        is_secret.cast("double").alias("secret"),
        F.when(is_secret, choose(51, keys)).otherwise(choose(52, others)).alias("token"),
        # short or plain hexadecimal strings are keys only where a name says so
        F.when(is_secret & (which.isin(1, 5, *range(6, len(keys)))), pick(53, ["password=", 'token = "', "secret: ", 'api_key="', "passwd="]))
        .when(is_secret, secret_before)
        .when(draw(52, len(others)) == 8, pick(54, ["commit ", "sha1 ", "revision ", "checksum: ", "digest="]))
        # plain words, also where a name says so
        .when(draw(52, len(others)) == 9, pick(67, ["password=", 'token = "', "secret: ", 'api_key="', "auth: "]))
        .otherwise(F.when(draw(52, len(others)) == 2, pick(55, ["/", "https://example.org/", "see /", "path "])).otherwise(plain_before))
        .alias("before"),
        pick(56, [" ", '"', "\n", ". ", ""]).alias("after"),
    )
    return rows


def _columns(tree: str, of: Column) -> Column:
    """A tree in its printed form as nested CASEs over the struct ``of``."""
    lines = [x.strip() for x in tree.splitlines() if x.strip() and not x.strip().startswith("Tree ")]
    at = 0

    def node() -> Column:
        nonlocal at
        line, at = lines[at], at + 1
        if line.startswith("Predict:"):
            return F.lit(float(line.split(":")[1]))
        feature, cut = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        yes = node()
        at += 1  # the line of Else
        return F.when(of[FEATURES[int(feature)]] <= float(cut), yes).otherwise(node())

    return node()


class Forest:
    """The share of a random forest's trees that call a finding a secret."""

    def __init__(self, printed: str):
        self.trees = re.split(r"Tree \d+ \(weight [\d.]+\):", printed)[1:]

    @staticmethod
    def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> "Forest":
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler

        rows = findings.select("secret", features(F.col("token"), F.col("before"), F.col("after")).alias("f")).select("secret", "f.*")
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
        forest = RandomForestClassifier(labelCol="secret", featuresCol="features", numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="onethird")
        return Forest(forest.fit(rows.select("secret", "features")).toDebugString)

    def score(self, of: Column) -> Column:
        return reduce(lambda a, b: a + b, (_columns(t, of) for t in self.trees)) / float(len(self.trees))


def _scored(found: Column, forest: Forest) -> Column:
    """array of struct(at, size, token, gap, score) of the candidates ``found``."""
    with_features = F.transform(found, lambda c: F.struct(c.alias("c"), features(c["token"], c["before"], c["after"]).alias("f")))
    one = lambda x: F.struct(
        x["c"]["at"].alias("at"), F.length(x["c"]["token"]).alias("size"), x["c"]["token"].alias("token"), x["c"]["gap"].alias("gap"), forest.score(x["f"]).alias("score")
    )
    return F.transform(with_features, one)


def scan(docs: DataFrame, forest: Forest | None = None, cut: float = CUT) -> DataFrame:
    """Per candidate of every whole text doc_id, start and end (characters from
    0), score and secret (1 from ``cut``); what it reads is not given. Null and
    empty texts have none; null and repeated doc_ids stay; an empty table gives
    no rows; other columns have no effect."""
    forest = forest or Forest.train(labelled_findings(session(docs)))
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).where(F.rlike("text", F.lit(HINT)))
    # of a column, not of an expression, Spark would test the whole search before the search
    rows = rows.select("doc_id", F.explode(_scored(candidates(F.col("text"))["all"], forest)).alias("f"))
    start = F.col("f.at").cast("long")
    return rows.select("doc_id", start.alias("start"), (start + F.col("f.size")).alias("end"), F.col("f.score").alias("score"), (F.col("f.score") >= cut).cast("int").alias("secret"))


def redact(docs: DataFrame, forest: Forest | None = None, cut: float = CUT, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret in text replaced by ``mark``; all else stays, null
    and empty texts too."""
    forest = forest or Forest.train(labelled_findings(session(docs)))

    def put(x: Column) -> Column:
        parts = F.transform(_scored(x["all"], forest), lambda f: F.concat(f["gap"], F.when(f["score"] >= cut, mark).otherwise(f["token"])))
        return F.concat(F.array_join(parts, ""), x["tail"])

    clean = F.when(F.rlike("text", F.lit(HINT)), bind(candidates(F.col("text")), put)).otherwise(F.col("text"))
    return spread(docs).withColumn("text", clean).select(*docs.columns)
