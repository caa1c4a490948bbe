"""Secret scans, in DataFrame functions and MLlib only.

Candidates are runs of 16 or more key-like characters in words, and values of 6 or more characters of any kind (but quotes,
commas and semicolons) that directly follow a keyed word and = or :. Shorter and unnamed ones aren't seen. A random forest over the candidate's length, character
transitions, dictionary coverage, path shape and neighbouring words, trained from labelled findings, removes false
positives. The forest is trained by MLlib, then written out as one SQL expression, so that scoring stays inside each
document's row: no candidate is exploded, joined or shuffled, and long or popular documents make no hot group.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Candidates, common letter pairs and words, neighbouring words.
SHAPE = r"[A-Za-z0-9_+/=\-]{16,}"
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur|un|ei|ie|qu|ci|os|ue|la"
WORDS = "the|and|ing|tion|ent|ion|tio|for|tha|her|ere|ate|his|con|res|ver|all|ons|nce|men|ith|ted|ers|pro|thi|wit|are|ess|not|ive|was|ect|rea|com|eve|per|int|est|sta|cti|ica|ist|ear|ain|one|our|iti|rat|path|file|name|user|data|test|page|index|value|config|token|secret|example|sample|your|here|public|local|home|http|www|mail|comment|ciones|mente|keit|ung|lich|schaft|eaux|elle"
KEYED = r"(?i)(secret|token|passwd|password|pwd|api_?-?key|apikey|auth|bearer|credential|access_?-?key|private)"
#: A keyed word with = or :, and a value after it in the same word, or in the next one (over the last three words).
NAMED = KEYED + r"""(?:s|key|value)?(?![a-z])[\w\-]*["']?"""
NAMED_VALUE = NAMED + r"""[=:]+["'`]?([^\s"'`,;]{6,})"""
NEXT_VALUE = NAMED + r"""(?: ?[=:]+ | [=:]+)["'`]?([^\s"'`,;]{6,})[^ ]*$"""
HASHED = r"(?i)(commit|sha-?\d*|md5|digest|checksum|hash|revision|uuid|guid|\bid\b|etag|build)"
MADE_UP = r"(?i)(example|sample|dummy|placeholder|your|changeme|xxxx|todo|test|\*\*\*\*|<.*>)"
KNOWN = r"^(AKIA|ASIA|ghp_|gho_|sk_live|sk-|xox[abp]-|eyJ|AIza|glpat-)"

FEATURES = ("length", "digits", "upper", "runs", "distinct", "dictionary", "pairs", "hex", "path", "address", "keyed", "hashed", "made_up", "known", "repeats", "named")


def candidates(text: Column, reach: int = 3) -> Column:
    """array<struct<at, word, before, after, value, named>>: the candidates of a text with the words around."""
    text = F.coalesce(text, F.lit(""))

    def gathered(words: Column, named: bool) -> Column:
        def found(w: Column, i: Column) -> Column:
            low = F.greatest(i - reach, F.lit(0))
            near = F.array_join(F.slice(words, low + 1, i - low), " ")
            after = F.coalesce(F.get(words, i + 1), F.lit(""))
            structs = lambda values, named: F.transform(values, lambda v: F.struct(i.alias("at"), w.alias("word"), near.alias("before"), after.alias("after"), v.alias("value"), F.lit(named).alias("named")))
            runs = F.regexp_extract_all(w, F.lit(SHAPE), F.lit(0))
            if not named:
                return F.when(F.length(w) >= 16, structs(runs, False))
            last = F.regexp_extract(F.concat_ws(" ", F.get(words, i - 2), F.get(words, i - 1), w), NEXT_VALUE, 2)
            values = F.array_union(F.regexp_extract_all(w, F.lit(NAMED_VALUE), F.lit(2)), F.array(last))
            return F.concat(structs(runs, False), structs(F.array_except(values, F.array_union(runs, F.array(F.lit("")))), True))

        return F.flatten(F.filter(F.transform(words, found), lambda x: x.isNotNull() & (F.size(x) > 0)))

    # the words are bound to a lambda's variable, so that they are split once; most texts name no value
    words = F.array(F.split(text, r"[\x20\x09-\x0D]+"))
    some = text.rlike(NAMED + r"[\x20\x09-\x0D]*[=:]")
    return F.when(some, F.transform(words, lambda w: gathered(w, True))[0]).otherwise(F.transform(words, lambda w: gathered(w, False))[0])


def distinct(v: Column) -> Column:
    """Distinct characters of a whole value: each printable ASCII character is looked for, so that time is linear in the length."""
    seen = F.size(F.filter(F.array(*[F.lit(chr(k)) for k in range(33, 127)]), lambda x: F.instr(v, x) > 0))
    return seen + F.size(F.array_remove(F.array_distinct(F.split(F.regexp_replace(v, r"[\x21-\x7E]+", ""), "")), ""))


def features(c: Column) -> Column:
    """array<double> in the order of FEATURES."""
    v, word = c["value"], c["word"]
    size = F.length(v).cast("double")
    share = lambda pattern, s=v: (F.length(s) - F.length(F.regexp_replace(s, pattern, ""))) / size
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return F.array(
        F.least(size, F.lit(200.0)),
        share("[0-9]"),
        share("[A-Z]"),
        F.size(F.regexp_extract_all(v, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0))) / size,
        distinct(v).cast("double") / F.least(size, F.lit(60.0)),
        share(WORDS, F.lower(v)),
        share(PAIRS, F.lower(v)),
        flag(v.rlike("^[0-9a-fA-F]+$")),
        flag(word.rlike(r"/[A-Za-z_.\-]+/|://|\.(py|js|java|rs|go|html?|txt|json|png|jpg|cfg|md)\b|^\.{0,2}/")),
        flag(word.rlike(r"@|://|www\.")),
        flag(c["named"] | F.concat_ws(" ", c["before"], F.regexp_extract(word, f"^(.*?){SHAPE}", 1)).rlike(KEYED)),
        flag(F.concat_ws(" ", c["before"], F.regexp_extract(word, f"^(.*?){SHAPE}", 1)).rlike(HASHED)),
        flag(F.concat_ws(" ", word, c["after"]).rlike(MADE_UP)),
        flag(v.rlike(KNOWN)),
        share(r"(.)\1{3,}"),
        flag(c["named"]),
    )


def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """(text, secret): short lines with one finding each, made by hash from documented shapes; the default labels."""
    part = lambda k, n, a="0123456789abcdef": F.translate(F.substring(F.sha2(F.concat_ws("-", F.col("id"), F.lit(k)), 512), 1, n), "0123456789abcdef", a)
    both = lambda k, n: F.concat(part(k, n // 2, "aB3xK9mQ7rT2wZ5e"), part(k + 50, n - n // 2, "Lp8HnV4sJy6GcD1u"))
    syllables = F.array(*map(F.lit, "the an er in on re at ing ti ou st en or ea nd ha es le ver schaft keit cion mente ado ment eau tion ai que der lich ung os ci ra la".split()))
    pick = lambda k: F.element_at(syllables, (F.pmod(F.xxhash64("id", F.lit(k)), F.size(syllables)) + 1).cast("int"))
    word = lambda k, n: F.concat(*[pick(100 * k + i) for i in range(n)])
    key = F.element_at(F.array(*map(F.lit, ("token", "api_key", "secret", "password", "access_key", "auth_token", "client_secret", "SECRET_KEY"))), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(8)) + 1).cast("int"))
    put = F.element_at(F.array(*map(F.lit, (' = "', '="', ": ", "=", ": '"))), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(5)) + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, ("password", "pwd", "passwd", "db_password", "token", "secret", "PASSWORD", "api_key"))), (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(8)) + 1).cast("int"))
    true = [
        F.concat(key, put, part(3, 40), F.lit('"')), F.concat(key, put, part(4, 32), F.lit('"')), F.concat(key, put, part(5, 64), F.lit('"')),
        F.concat(key, put, both(6, 24)), F.concat(key, put, both(7, 40), F.lit("==")), F.concat(key, put, both(8, 32), F.lit('"')),
        F.concat(F.lit("AKIA"), part(9, 16, "A7BC2DE3FG4HJ5KL")), F.concat(F.lit("ghp_"), both(10, 36)), F.concat(F.lit("Authorization: Bearer eyJ"), both(11, 60)),
        F.concat(F.lit("sk_live_"), both(12, 24)), F.concat(key, F.lit(" "), both(13, 20)), F.concat(F.lit("xoxb-"), part(14, 12, "0123456789012345"), F.lit("-"), both(15, 24)),
        F.concat(name, put, both(60, 8)), F.concat(name, put, word(61, 2), part(62, 1, "0123456789012345")), F.concat(name, put, both(63, 6), F.lit("&"), part(64, 3)), F.concat(name, put, F.initcap(word(65, 2)), part(66, 4, "0123456789012345"), F.lit("!")),
        F.concat(name, put, part(67, 3), word(68, 2), part(69, 2, "!$%&#+*?!$%&#+*?")), F.concat(key, put, both(70, 12), F.lit("."), both(71, 10), F.lit("."), both(72, 8)),
    ]
    false = [
        F.concat(F.lit("commit "), part(20, 40)), F.concat(F.lit("sha256 checksum "), part(21, 64)), F.concat(word(22, 3), F.lit("."), part(23, 2, "0123456789012345"), F.lit("@mail"), part(24, 1), F.lit(".example.com")),
        word(25, 8), F.concat(word(26, 6), F.lit(", "), word(27, 9)), F.concat(F.lit("/home/user/"), word(28, 3), F.lit("/"), word(29, 3), F.lit("_"), part(30, 2), F.lit(".py")),
        F.concat(F.lit("https://www.example.com/"), word(31, 4), F.lit("/"), word(32, 3), F.lit("-"), part(33, 4)), F.concat(key, F.lit(' = "your_'), key, F.lit('_goes_here"')), part(34, 16, "0123456789012345"),
        F.concat(F.lit("id "), part(35, 8), F.lit("-"), part(36, 4), F.lit("-"), part(37, 4), F.lit("-"), part(38, 12)), F.concat(key, put, F.lit("xxxxxxxxxxxxxxxxxxxxxxxx")), F.concat(key, F.lit(" = get_"), word(39, 2), F.lit("_"), word(40, 3), F.lit("()")),
        F.concat(word(41, 4), F.lit("-"), word(42, 4)), F.concat(F.lit("md5 digest "), part(43, 32)), F.concat(key, F.lit(" "), word(44, 8)), F.concat(F.upper(word(45, 7)), F.lit("!!")), F.concat(F.lit("===="), F.repeat(F.lit("="), 30)), F.repeat(F.lit("-"), 40),
        F.concat(name, put, word(80, 3)), F.concat(name, F.lit(": "), F.element_at(F.array(*map(F.lit, ("required", "optional", "string", "undefined", "os.environ", "self.token", "********", "<password>"))), (F.pmod(F.xxhash64("id", F.lit(81)), F.lit(8)) + 1).cast("int"))),
        F.concat(name, put, word(82, 2), F.lit("."), word(83, 2), F.lit("()")), F.concat(name, F.lit(": "), word(84, 4), F.lit(".")), F.concat(name, F.lit(' = "your_'), name, F.lit('"')), F.concat(name, put, word(85, 2), F.lit("_"), word(86, 2)),
    ]
    kinds = true + false
    kind = F.pmod(F.xxhash64("id", F.lit(0)), F.lit(len(kinds))).cast("int")
    line = F.coalesce(*[F.when(kind == k, x) for k, x in enumerate(kinds)])
    text = F.concat_ws(" ", word(46, 2), word(47, 3), line, word(48, 2))
    return spark.range(rows).select(text.alias("text"), (kind < len(true)).cast("int").alias("secret"))


def forest_sql(dump: str, feature: str = "f") -> str:
    """MLlib's printed forest as SQL: the share of trees that vote 1."""
    trees: list[list[str]] = []
    for line in dump.splitlines()[1:]:
        if (s := line.strip()).startswith("Tree "):
            trees.append([])
        elif s:
            trees[-1].append(s)

    def node(lines: list[str], at: int) -> tuple[str, int]:
        if m := re.fullmatch(r"Predict: (\S+)", lines[at]):
            return f"{float(m[1])}D", at + 1
        m = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", lines[at])
        if not m:
            raise ValueError(f"unknown line in a forest: {lines[at]}")
        yes, after = node(lines, at + 1)
        no, after = node(lines, after + 1)
        return f"CASE WHEN {feature}[{m[1]}] <= {float(m[2])!r}D THEN {yes} ELSE {no} END", after

    return "(" + " + ".join(node(t, 0)[0] for t in trees) + f") / {len(trees)}D"


def train(findings: DataFrame, trees: int = 20, depth: int = 6, limit: int = 20_000) -> str:
    """A forest from labelled findings (text, secret), of which up to `limit` rows, by hash, are used; as SQL over `f`."""
    rows = findings.where("text is not null and secret is not null").orderBy(F.xxhash64("text"), "text").limit(limit)
    rows = rows.select(F.explode(candidates(F.col("text"))).alias("c"), F.col("secret").cast("double").alias("label"))
    rows = C.stored(rows.select(features(F.col("c")).alias("f"), "label"), "findings").select(array_to_vector("f").alias("x"), "label")
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt", subsamplingRate=0.8).fit(rows)
    return forest_sql(model.toDebugString)


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with n_candidates, findings (array<struct<at, value, score>> of at least the threshold) and redacted (the text
    with every found value replaced by [REDACTED]); the columns of docs stay, but for those of these names.

    Null and empty texts have no candidates and keep their text. Repeated rows are scanned each for itself. Values are
    compared whole: equal values in one text are all replaced. Columns of docs named n_candidates, findings or redacted are replaced; an empty table gives an empty result.
    """
    forest = train(labelled_findings(docs.sparkSession) if findings is None else findings)
    docs = docs.drop("n_candidates", "findings", "redacted")
    found, scored = C.fresh(docs, "found"), C.fresh(docs, "scored")
    judged = F.expr(f"transform({found}, c -> transform(array(c.f), f -> named_struct('at', c.at, 'value', c.value, 'score', {forest}))[0])")
    with_f = F.transform(candidates(F.col(text_col)), lambda c: F.struct(c["at"].alias("at"), c["value"].alias("value"), features(c).alias("f")))
    out = docs.withColumn(found, with_f).withColumn(scored, judged)
    out = out.withColumn("n_candidates", F.size(scored).cast("long")).withColumn("findings", F.filter(scored, lambda x: x["score"] >= threshold))
    values = F.array_sort(F.array_distinct(F.transform("findings", lambda x: x["value"])), lambda a, b: F.length(b) - F.length(a))
    hide = F.aggregate(values, F.col(text_col), lambda t, v: F.replace(t, v, F.lit("[REDACTED]")))
    return out.withColumn("redacted", hide).drop(found, scored)
