"""Secret scans: candidates found by one pattern, false positives removed by a random forest.

Only DataFrame functions run on the executors. A candidate is, at its first character, the first that fits of
- a private key's block,
- a value of at least 6 characters assigned to a secret's name: up to its closing quote, or else up to white
  space or the next `&name=`, without closing punctuation; the value of a Bearer header is one too,
- a password in an address (`//user:password@host`), of at least 6 characters,
- a JWT or another token of three dotted parts, whole,
- a run of at least 14 characters of the alphabets of keys and hashes with a digit or two capitals in a row.
Not candidates: shorter values, values with spaces, and unassigned runs of small letters. Its features are its
length, its character classes and transitions, how much of it words of a dictionary and common letter pairs cover
(the dictionary is the whole words of a public vocabulary, some 12,000 of several languages), whether it stands in a
path or an address, and its neighbouring words. The forest learns from labelled findings: a table of passages
(text, secret; null where there is none), which a caller gives. `made_findings` makes one where none is at hand:
its labels say which generator wrote a passage, and no pattern or feature of this module has a part in them. At most
`most` findings with the smallest hash train; that bounds what training reads, not what is scored.

Defined cases: a null or empty text has no candidates; repeated rows give their findings each; a null id
keeps its findings; without labelled findings of both kinds the probability is the share of secrets in them,
or 0.5; whole texts of any length are scanned; an empty table gives no findings; `redact` passes other columns
through, whatever their names, and replaces secrets where they were found, in every row of that id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch, fresh, table
from tabulon.llm.pieces import SPACE, default_model

_RUN = "A-Za-z0-9_+/\\-"
_RUNS = f"(?<![{_RUN}])(?=[{_RUN}]{{14}})(?=[A-Za-z_+/\\-]*(?:[0-9]|[A-Z][A-Z]))[{_RUN}]{{14,}}+={{0,2}}"
# Common letter pairs, names of secrets, and of what looks like them.
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ei|ie|qu|ue|ge|be|un|sh|ly|bl|wh"
NAMES = "(?i)(pass(word|wd|phrase)?|pwd|token|secret|api[_-]?key|access[_-]?key|private[_-]?key|key|auth|credentials?|bearer)"
HARMLESS = "(?i)\\b(commit|sha-?[0-9]*|md5|checksum|digest|hash|version|uuid|guid|id|isbn|file|path|image|img|src|href|url|http|https|www|date|time|phone|tel|card|paid|order|invoice|see|at)\\W{0,4}$"
#: What stands between a name and its value, without the value's quote; bounded, as lookbehinds must be.
_SIGN = "[\"']?\\s{0,4}(?::=|=>|==?|:)\\s{0,4}"
_ASSIGNED = f"{NAMES}(?-i){_SIGN}"
# the short lookbehinds spare most places the long ones
_VALUES = "|".join([
    f"(?<=[=:>]\\s{{0,4}}\")(?<={_ASSIGNED}\")[^\\s\"]{{6,}}(?=\")",
    f"(?<=[=:>]\\s{{0,4}}')(?<={_ASSIGNED}')[^\\s']{{6,}}(?=')",
    f"(?:(?<=[=:>]\\s{{0,4}})(?<={_ASSIGNED})|(?<=[rR]\\s)(?<=(?i:bearer)\\s))(?!=)(?:(?![&;]\\w{{1,40}}=)[^\\s\"']){{6,}}(?<![,;.:)\\]}}>])",
])
_ADDRESS = "(?<=:)(?<=://[^\\s/:@]{0,64}:)[^\\s/@]{6,}(?=@)"
_PART = "[A-Za-z0-9_-]"
_JWT = f"eyJ{_PART}{{7,}}(?:\\.{{1,2}}{_PART}+){{1,4}}"
_DOTTED = f"(?<![{_RUN}.])(?:{_JWT}|{_PART}{{2,}}\\.{_PART}{{6,}}\\.(?=[A-Za-z_-]*[0-9]){_PART}{{16,}})"
_BLOCK = "-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\\s\\\\]{16,}(?:-----END (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----)?"
CANDIDATE = f"{_BLOCK}|{_VALUES}|{_ADDRESS}|{_DOTTED}|{_RUNS}"
#: Assigned texts that stand for a value: words of code and manuals, variables, calls, marks to fill in.
PLACEHOLDERS = "(?i)^(?:true|false|null|none|undefined|required|optional|string|integer|password|passwd|secret|token|example|default|changeme|your[_-].*|x{3,}|\\*{3,}|\\.{3,}|[$<{%(\\[].*|[a-z_][\\w.]*[(\\[].*|[a-z_]+(?:\\.[a-z_]+)+)$"
#: Names that only secrets have, and how a password in an address is preceded.
STRONG = "(?i)(pass(word|wd|phrase)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?\\s*(:=|=>|==?|:)\\s*[\"']?$"
ADDRESS = "://[^\\s/:@]*:$"
FEATURES = ["length", "digits", "capitals", "hex", "transitions", "variety", "vowels", "pairs", "covered", "path", "named", "assigned", "quoted", "equals", "strong", "filler", "address", "harmless", "prose", "block"]


def share(pattern: str, of: Column) -> Column:
    return F.regexp_count(of, F.lit(pattern)) / F.length(of)


def candidates(docs: DataFrame) -> DataFrame:
    """(row, k, doc_id, text_key, start, candidate, before, after) of docs (doc_id, text).

    k numbers a row's candidates from 0, start counts characters from 0, and text_key is a hash of the row's text.
    """
    found = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    some = docs.select("doc_id", "text").filter(F.col("text").rlike(CANDIDATE)).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_key"), "text", found.alias("found"))
    some = some.select("row", "doc_id", "text_key", "found", F.split("text", CANDIDATE, -1).alias("gaps"))
    n = F.size("found")
    each = F.arrays_zip(
        F.col("found").alias("candidate"),
        F.transform(F.slice("gaps", 1, n), lambda g: F.right(g, F.lit(64))).alias("before"),
        F.transform(F.slice("gaps", 2, n), lambda g: F.left(g, F.lit(32))).alias("after"),
        F.transform(F.slice("gaps", 1, n), F.length).alias("gap"),
    )
    rows = some.select("row", "doc_id", "text_key", F.posexplode(each).alias("k", "c")).select("row", "doc_id", "text_key", "k", "c.*")
    upto = Window.partitionBy("row").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.col("gap") + F.length("candidate")).over(upto) - F.length("candidate")
    return rows.select("row", "k", "doc_id", "text_key", start.cast("long").alias("start"), "candidate", "before", "after")


def dictionary(spark: SparkSession, model: str | None = None) -> DataFrame:
    """(word): the whole words of at least 3 letters in a vocabulary file, in small letters."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model or default_model())
    pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
    words = sorted({p[1:].lower() for p in pieces if p[0] == SPACE and len(p) > 3 and p[1:].isalpha()})
    return spark.range(1).select(F.explode(F.split(F.lit(" ".join(words)), " ")).alias("word"))


def described(found: DataFrame) -> DataFrame:
    """candidates with FEATURES, doubles."""
    # letters in words of the dictionary; the file bounds its size, so it is sent to the candidates
    runs = F.regexp_extract_all("candidate", F.lit("\\p{Lu}?\\p{Ll}{2,}|\\p{Lu}{3,}"), F.lit(0))
    parts = found.withColumn("part", F.explode_outer(F.transform(runs, F.lower)))
    parts = parts.join(F.broadcast(dictionary(found.sparkSession)), F.col("part") == F.col("word"), "left")
    rest = [c for c in found.columns if c not in ("row", "k")]
    found = parts.groupBy("row", "k").agg(*[F.first(c).alias(c) for c in rest], F.sum(F.when(F.col("word").isNotNull(), F.length("part")).otherwise(0)).alias("known"))
    c, low = F.col("candidate"), F.lower("candidate")
    flag = lambda x: x.cast("double")
    turns = "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"
    columns = {
        "length": F.length(c).cast("double"),
        "digits": share("[0-9]", c),
        "capitals": share("[A-Z]", c),
        "hex": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "transitions": share(turns, c),
        "variety": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        "vowels": share("[aeiou]", low),
        "pairs": share(PAIRS, low),
        "covered": F.col("known") / F.length(c),
        "path": flag(F.col("before").rlike("([/\\\\.@]|://\\S*)$") | F.col("after").rlike("^([/\\\\@]|\\.[a-z])")),
        "named": flag(F.col("before").rlike(NAMES + "\\W{0,4}$")),
        "assigned": flag(F.col("before").rlike("[=:]\\s*[\"']?$")),
        "quoted": flag(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")),
        "equals": flag(F.col("before").rlike("=>?\\s*[\"']?$")),
        "strong": flag(F.col("before").rlike(STRONG)),
        "filler": flag(c.rlike(PLACEHOLDERS)),
        "address": flag(F.col("before").rlike(ADDRESS) & F.col("after").startswith("@")),
    }
    columns |= {
        "harmless": flag(F.col("before").rlike(HARMLESS)),
        "prose": flag(F.col("before").rlike("[A-Za-z]\\W{0,2}\\s+$")),
        "block": flag(c.startswith("-----BEGIN")),
    }
    return found.withColumns({k: v.cast("double") for k, v in columns.items()})


def made_findings(spark: SparkSession, n: int = 12_000) -> DataFrame:
    """(doc_id, text, secret): passages of invented texts, every second with a secret, in as many shapes as are listed."""
    seed = lambda k: F.concat_ws("/", F.lit(f"finding {k}"), "id")
    hexa = lambda k, m: F.left(F.sha2(seed(k), 256), F.lit(m))
    code = lambda k, m: F.left(F.concat(F.base64(F.unhex(F.sha2(seed(k), 512))), F.base64(F.unhex(F.sha2(seed(f"{k}+"), 512)))), F.lit(m))
    mixed = lambda k, m: F.left(F.translate(code(k, 100), "+/=", "k7"), F.lit(m))
    small = lambda k, m: F.left(F.translate(F.lower(mixed(k, 90)), "0123456789", ""), F.lit(m))
    digits = lambda k, m: F.left(F.translate(F.sha2(seed(k), 512), "abcdef", ""), F.lit(m))
    upto = lambda k, low, high: (F.pmod(F.xxhash64(seed(k)), F.lit(high - low + 1)) + low).cast("int")
    words = "time people water house letter river light market answer story table garden window morning question account service number system project report figure moment office nature camino tiempo ciudad noche maison jardin fleuve lumiere haus garten strasse wasser abend".split()
    word = lambda k: F.element_at(F.array(*[F.lit(w) for w in words]), upto(k, 1, len(words)))
    path = F.concat_ws("/", word("p1"), word("p2"), F.concat(word("p3"), digits("p4", 2)), F.concat(word("p5"), F.lit(".html")))
    password = F.concat(mixed("pw", 12).substr(F.lit(1), upto("pwl", 6, 12)), digits("pwd", 1))
    broken = F.concat(mixed("b1", 4), F.element_at(F.array(*[F.lit(x) for x in "&!$.#%"]), upto("b2", 1, 6)), mixed("b3", 5), F.lit("!"), digits("b4", 2))
    jwt = F.concat(F.lit("eyJ"), mixed("j1", 24), F.lit(".eyJ"), mixed("j2", 40), F.lit("."), F.translate(code("j3", 43), "+/=", "-_"))
    name = lambda k, *of: F.element_at(F.array(*[F.lit(x) for x in of]), upto(k, 1, len(of)))
    names = name("n", "password", "PASSWORD", "passwd", "pwd", "secret", "token", "api_key", "apiKey", "access_key", "client_secret", "auth_token", "Password")
    sign = name("s", ' = "', "='", ": '", '="', '": "', " := \"")
    close = F.right(sign, F.lit(1))
    bare = name("e", "=", ": ", " = ")
    # (before, secret, after)
    good = [
        (F.lit('token = "'), hexa(1, 40), F.lit('"')),
        (F.concat(names, sign), password, close),
        (F.concat(names, sign), broken, close),
        (F.concat(names, sign), small("sm", 12), close),
        (F.concat(names, bare), F.concat(mixed("v", 14), digits("v1", 2)), F.lit("")),
        (F.concat(names, F.lit("=")), broken, F.lit("")),
        (F.concat(names, bare), hexa(2, 18), F.lit("")),
        (F.concat(names, sign), code("c", 40), close),
        (F.concat(F.lit("/login?"), name("q", "token", "key", "access_token"), F.lit("=")), password, F.lit("&user=ann")),
        (F.lit("AWS_SECRET_ACCESS_KEY="), code("aws", 40), F.lit("")),
        (F.concat(name("pr", "postgres", "mysql", "https", "redis"), F.lit("://admin:")), password, F.lit("@db.example.com/main")),
        (F.lit(""), F.concat(name("ak", "AKIA", "ASIA"), F.left(F.translate(F.upper(mixed("a", 60)), "0189", ""), F.lit(16))), F.lit("")),
        (F.lit(""), F.concat(name("gh", "ghp_", "gho_", "ghs_"), mixed("g", 36)), F.lit("")),
        (F.lit(""), F.concat(name("sk", "sk-", "sk_live_", "xoxb-", "glpat-"), mixed("k", 32)), F.lit("")),
        (F.lit(""), jwt, F.lit("")),
        (F.lit("Authorization: Bearer "), F.when(upto("w", 0, 1) == 0, jwt).otherwise(mixed("bt", 40)), F.lit("")),
        (F.lit(""), F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), code("pem", 150), F.lit("\n-----END RSA PRIVATE KEY-----")), F.lit("")),
        (F.concat(name("hk", "key ", "the token ", "secret "), bare), hexa(3, 32), F.lit("")),
    ]
    bad = [
        F.concat(name("c1", "commit ", "fixed in ", "merge ", "tree "), hexa(4, 40)),
        F.concat(name("c2", "sha256:", "checksum: ", "md5 ", "digest = "), hexa(5, 64).substr(F.lit(1), upto("hl", 32, 64))),
        F.concat(name("u0", "id = ", "uuid: ", "request "), F.concat_ws("-", hexa(6, 8), hexa(7, 4), hexa(8, 4), hexa(9, 4), hexa(10, 12))),
        F.concat(F.lit("see "), name("w1", "www.example2.com/", "https://example.org/", "/usr/lib64/", "../"), path),
        F.concat(F.upper(F.concat_ws("_", word("k1"), word("k2"), word("k3"))), F.lit("_"), digits("k4", 1)),
        F.upper(F.concat(word("k5"), word("k6"), word("k7"))),
        F.concat(word("i1"), F.initcap(word("i2")), F.initcap(word("i3")), digits("i4", 1), F.initcap(word("i5"))),
        F.concat(name("m1", "paid with ", "card ", "call ", "invoice ", ""), digits("m2", 16)),
        F.concat(names, F.lit(" = "), name("f1", "getpass.getpass()", "os.environ['SECRET_1']", "request.form.get(name2)", "None", "config.password")),
        F.concat(names, sign, name("f2", "${TOKEN}", "<your token>", "changeme", "********", "{{ secret }}", "xxxxxxxx", "example"), close),
        F.concat(names, F.lit(": "), name("f3", "required", "string", "everything else follows", "optional", "integer, not null")),
        F.concat(F.lit("the "), name("f4", "key", "token", "secret", "password"), F.lit(": "), word("f5"), F.lit(" "), word("f6")),
        F.concat(F.lit("key = "), F.concat_ws("_", word("v1"), word("v2"), word("v3"))),
        F.concat(F.lit("2024-0"), digits("d1", 1), F.lit("-1"), digits("d2", 1), F.lit("T0"), digits("d3", 1), F.lit("-00-00-000")),
        F.concat(F.lit("version "), F.concat_ws(".", digits("x1", 1), digits("x2", 2), digits("x3", 2)), F.lit("-alpha-build-"), digits("x4", 4)),
        F.concat(word("e1"), F.lit("."), word("e2"), digits("e3", 3), F.lit("@example.com")),
        F.concat(F.lit("<img src=data:image/png;base64,"), code("im", 120), F.lit(">")),
        F.concat_ws("-", word("h1"), word("h2"), word("h3"), digits("h4", 3)),
    ]
    shapes = [*[(F.concat(*g), g[1]) for g in good], *[(b, F.lit(None).cast("string")) for b in bad]]
    around = lambda *ks: F.concat_ws(" ", *[word(k) for k in ks])
    out = None
    for k, (said, secret) in enumerate(shapes):  # a plan for each shape, as code of all would be too long to compile
        rows = spark.range(0, n // len(shapes), 1, 1).select((F.col("id") * len(shapes) + k).alias("id"))
        text = F.concat(around("t1", "t2", "t3"), name("t4", " ", ". ", "\n", "\t"), said, F.lit(" "), around("t5", "t6"))
        rows = rows.select(F.col("id").alias("doc_id"), text.alias("text"), secret.alias("secret"))
        out = rows if out is None else out.union(rows)
    return out


def labelled_candidates(scratch: Scratch, passages: DataFrame) -> DataFrame:
    """FEATURES and label of the candidates in passages (text, secret): 1 for those that are, hold or are part of the secret."""
    told = scratch.save(passages.select(F.monotonically_increasing_id().alias("doc_id"), "text", "secret"), "passages")
    found = described(candidates(told)).join(told.select("doc_id", "secret"), "doc_id")
    hit = F.col("secret").isNotNull() & ((F.instr("candidate", F.col("secret")) > 0) | (F.instr("secret", F.col("candidate")) > 0))
    return found.select(*FEATURES, hit.cast("double").alias("label"))


def judged(scratch: Scratch, found: DataFrame, labelled: DataFrame | None = None, most: int = 20_000, trees: int = 30) -> DataFrame:
    """Candidates with FEATURES and `probability` of being a secret; labelled: passages (text, secret), by default made_findings."""
    rows = scratch.save(described(found), "described")
    picked = scratch.save(labelled_candidates(scratch, made_findings(scratch.spark) if labelled is None else labelled), "labelled")
    taught = None
    for kind in (0, 1):  # as many of either kind at most
        part = picked.filter(F.col("label") == kind).orderBy(F.xxhash64(*FEATURES), *FEATURES).limit(most // 2)
        taught = part if taught is None else taught.union(part)
    taught = scratch.save(taught.coalesce(1), "taught")
    counts = {r["label"]: r["count"] for r in taught.groupBy("label").count().collect()}
    if len(counts) < 2:
        return rows.withColumn("probability", F.lit(next(iter(counts), 0.5)))
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    gather = VectorAssembler(inputCols=FEATURES, outputCol="__features", handleInvalid="keep")
    weight = F.when(F.col("label") == 1, sum(counts.values()) / 2 / counts[1.0]).otherwise(sum(counts.values()) / 2 / counts[0.0])
    forest = RandomForestClassifier(featuresCol="__features", labelCol="label", weightCol="weight", probabilityCol="__probability", predictionCol="__prediction", rawPredictionCol="__raw", numTrees=trees, maxDepth=8, maxBins=64, seed=7)
    fitted = forest.fit(gather.transform(taught.withColumn("weight", weight)))
    out = fitted.transform(gather.transform(rows))
    return out.withColumn("probability", vector_to_array("__probability")[1]).drop("__features", "__raw", "__probability", "__prediction")


def scan(scratch: Scratch, docs: DataFrame, threshold: float = 0.5, labelled: DataFrame | None = None) -> DataFrame:
    """Every candidate of docs: doc_id, text_key, k, start, candidate, probability and secret."""
    found = judged(scratch, candidates(docs), labelled)
    return found.select("doc_id", "text_key", "k", "start", "candidate", "probability", (F.col("probability") >= threshold).alias("secret"))


def redact(scratch: Scratch, docs: DataFrame, mark: str = "[SECRET]", threshold: float = 0.5, labelled: DataFrame | None = None) -> DataFrame:
    """docs with every secret replaced by a mark where it was found."""
    id_, key, hidden = fresh(docs, "id", "key", "hidden")
    found = scan(scratch, docs, threshold, labelled).filter("secret")
    places = found.groupBy(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).agg(F.collect_set("k").alias(hidden))
    joined = docs.join(places, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)), "left")
    parts = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    shown = F.transform(parts, lambda c, k: F.when(F.array_contains(F.col(hidden), k), F.lit(mark)).otherwise(c))
    between = F.split("text", CANDIDATE, -1)
    clean = F.array_join(F.transform(F.arrays_zip(between.alias("gap"), shown.alias("own")), lambda x: F.concat(x["gap"], F.coalesce(x["own"], F.lit("")))), "")
    return joined.withColumn("text", F.when(F.col(hidden).isNull(), F.col("text")).otherwise(clean)).select(*docs.columns)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(Scratch(spark, "secrets"), table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "secret")
