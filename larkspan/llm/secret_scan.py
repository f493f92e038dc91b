"""Secret scanning: candidates by pattern, false positives removed by a random forest. DataFrame functions only."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.llm.common import materialise

#: Parts of a key's name.
_WORDS = r"(?i:token|secret|passw(?:or)?d|passphrase|(?<![A-Za-z])pass(?![\w-])|pwd|api[_-]?key|auth|credential|private[_-]?key|access[_-]?key|bearer|client[_-]?key|signing)"
#: A whole name with such a part and its sign. Only words that a sign follows are searched for a part; a name is read
#: once, however long: nothing is given back.
_NAMED = rf"""(?<![\w-])(?=[\w-]++(?:["']|&quot;)?[ \t]*+[:=])(?>[\w-]*?{_WORDS})[\w-]*+(?:["']|&quot;)?[ \t]*+(?::=|=>|[=:])[ \t]*+"""
_TAGGED = rf"""<(?>[\w:.-]*?{_WORDS})[\w:.-]*+(?:\s[^<>]*+)?>\s*+"""
#: What a value isn't: a key in PEM or a URL with a login, which are found on their own.
_OTHER = r"""(?!-----BEGIN |[A-Za-z][A-Za-z0-9+.-]*+://[^\s/:@"'<>]*+:[^\s/"'<>]+@)"""
_WEB = r"[A-Za-z0-9_-]"
_PEM = r"PRIVATE KEY(?: BLOCK)?-----"
_END = r"(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
#: Values of 8 and more characters that a key's name announces, in quotes, without them (up to closing marks) and in a
#: tag; passwords in URLs; whole JWTs; runs of 16 and more key characters; private keys in PEM, whole or without an end.
#: No part has a greatest length. Groups with a name starting in b are what stands before a value, those in v values.
CANDIDATE = "|".join((
    rf"""(?<b1>{_NAMED})(?:(?<b2>["']{_OTHER})(?<v1>[^\s"']{{8,}})(?=["'])|(?<b3>(?:["']|&quot;)?(?:(?i:bearer|basic) )?{_OTHER})(?<v2>[^\s"'&<>=]{{8,}}(?<![,;:.)\]}}]){_END}))""",
    rf"(?<b4>{_TAGGED})(?<v3>[^\s<>]{{8,}})(?=\s*+</)",
    r"""(?<b5>://[^\s/:@"'<>]*+:)(?<v4>[^\s/"'<>]+)(?=@)""",
    rf"(?<v5>(?<![A-Za-z0-9_])eyJ{_WEB}{{5,}}\.{_WEB}*\.{_WEB}*(?:\.{_WEB}+){{0,2}})",
    rf"(?<v6>(?<![A-Za-z0-9_+/-])[A-Za-z0-9+/_-]{{16,}}{_END})",
    rf"(?<v7>-----BEGIN [A-Z0-9 ]*{_PEM}(?:[\s\S]*?(?:(?=-----BEGIN )|-----END [A-Z0-9 ]*{_PEM})|(?=[\s\\nr]{{1,8}}[A-Za-z0-9+/]{{32}})[A-Za-z0-9+/=\\\r\n]*+))",
))
_BEFORE_VALUE = "".join(f"${{b{i}}}" for i in range(1, 6))
_VALUE = "".join(f"${{v{i}}}" for i in range(1, 8))
#: Characters of context on either side that the forest sees; a candidate has one at least, so as many neighbours hold them.
BEFORE, AFTER = 80, 24

#: Words that make up identifiers, paths and placeholders rather than keys.
DICTIONARY = (
    "access account action active address agent array author base between binary block body book buffer build button cache call center change "
    "channel check class client close cloud code color column command comment component config connect container content context control copy "
    "count create current custom data database date debug default delete demo device document domain download dummy dynamic element enable entry "
    "error event example export factory false field file filter final find first folder format frame from function global header height hello "
    "here hidden image import index info input item label layout level library line link list load local lock login long main manager map master "
    "media memory message method model module name network next node null number object offset open option output package page parser pass path "
    "pattern place placeholder point port process product property protocol public query read record register release remove replace report "
    "request response result return router save schema screen script search sequence service session setting shared show simple source start "
    "state status storage store string style system table task test text that this time title token tool true type update user util value version "
    "view write your"
).split()

KEY_WORDS = r"(?i)(token|secret|passw(or)?d|passphrase|(?<![a-z])pass(?![\w-])|pwd|api[_-]?key|apikey|auth|credential|private[_-]?key|access[_-]?key|bearer|client[_-]?key|signing)"
OTHER_WORDS = r"(?i)(commit|revision|sha-?[0-9]+|md5|checksum|digest|etag|hash|uuid|guid|build|version|serial|order|isbn|base64|image|integrity|example|sample|dummy|placeholder|revoked)"
FEATURES = [
    "length", "transitions", "digits", "uppers", "distinct", "hex", "only_digits", "uuid", "vowel_turns", "longest_run", "dictionary", "slashes",
    "placeholder", "prefix", "key_word", "key_word_next", "other_word", "assigned", "quoted", "in_path", "test_path", "code_path", "is_name", "jwt", "pem", "url_login",
    "call", "marks",
]


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def with_features(found: DataFrame) -> DataFrame:
    """Adds FEATURES to rows with candidate, before, after and path. Null texts count as empty."""
    c, path = F.col("candidate"), F.coalesce(F.col("path"), F.lit(""))
    announced = F.col("announced") if "announced" in found.columns else F.lit("")  # also by what is longer than the context
    before, after = F.coalesce(F.col("before"), F.lit("")), F.coalesce(F.col("after"), F.lit(""))
    n = F.length(c).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    values = {
        "length": n,
        "transitions": share("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[^A-Za-z0-9](?=[A-Za-z0-9])"),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(40.0)),
        "hex": _flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "only_digits": _flag(c.rlike("^[0-9]+$")),
        "uuid": _flag(c.rlike("^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$")),
        "vowel_turns": share("(?i)[aeiouy](?=[bcdfghjklmnpqrstvwxz])|[bcdfghjklmnpqrstvwxz](?=[aeiouy])"),
        "longest_run": _flag(c.rlike(r"(.)\1{4,}")),
        "dictionary": 1.0 - F.length(F.regexp_replace(F.lower(c), words, "")) / n,
        "slashes": share("[/_-]"),
        "placeholder": _flag(c.rlike("(?i)(x{6,}|your|example|sample|dummy|change|insert|replace|placeholder|0{8,}|1234567|abcdef)")),
        "prefix": _flag(c.rlike("^(AKIA|ASIA|gh[pousr]_|glpat-|sk[-_]|pk_|rk_|xox[abprs]-|AIza|eyJ|SG)")),
        "key_word": _flag(before.rlike(KEY_WORDS) | (F.coalesce(announced, F.lit("")) == "named")),
        "key_word_next": _flag(before.rlike(KEY_WORDS + r"""[\w-]*(["']|&quot;)?\s*([=:>]|:=|=>|\s)\s*(["']|&quot;)?(Bearer )?$""") | (F.coalesce(announced, F.lit("")) == "named")),
        "other_word": _flag(before.rlike(OTHER_WORDS)),
        "assigned": _flag(before.rlike(r"""[=:]\s*(["']|&quot;)?$""")),
        "quoted": _flag(before.rlike(r"""(["']|&quot;)$""") & after.rlike(r"""^(["']|&quot;)""")),
        "in_path": _flag(before.rlike(r"""([/\\.]|https?:)\S*$""") | after.rlike(r"^(\.[a-z]{2,4}\b|[/\\])")),
        "is_name": _flag(after.rlike(r"""^(["']|&quot;)?[ \t]{0,3}(:=|=>|[=:][^=:/])""")),
        "jwt": _flag(c.rlike(r"^eyJ[\w-]{8,}\.[\w-]*\.[\w-]{16,}")),
        "pem": _flag(c.rlike("^-----BEGIN ")),
        "url_login": _flag((before.rlike(r"://[^\s/:@]*:$") | (F.coalesce(announced, F.lit("")) == "login")) & after.startswith("@")),
        "call": _flag(c.rlike(r"[(\[{$<]|^[A-Za-z_]+(\.[A-Za-z_]+)+$") | after.rlike(r"^[(\[]")),
        "marks": share("[^A-Za-z0-9/_-]"),
        "test_path": _flag(path.rlike("(?i)(test|fixture|example|sample|mock|doc|readme)")),
        "code_path": _flag(path.rlike(r"(?i)\.(py|js|ts|java|go|rb|php|c|cpp|sh|ya?ml|json|env|ini|cfg|toml|properties)$")),
    }
    return found.withColumns({k: F.coalesce(v, F.lit(0.0)).cast("double") for k, v in values.items()})


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """One row a candidate: id, ordinal in its text, start, candidate, before, after, path, and by what it is announced, if it is.

    before and after are the text's characters next to the candidate, also where they belong to other candidates.
    """
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    # One search of the text: what announces a candidate and the candidate are set between marks that it can't hold, as
    # they are its own digest. Parts come in threes: a gap, an announcer, which may be empty, and a candidate.
    mark = F.concat(F.lit("\x01"), F.md5("text"), F.lit("\x02"))
    parts = F.split(F.regexp_replace(text, F.lit(CANDIDATE), F.concat(mark, F.lit(_BEFORE_VALUE), mark, F.lit(_VALUE), mark)), mark, -1)
    each = rows.select("id", "row", "path", F.octet_length("text").alias("whole"), F.posexplode(parts).alias("place", "part"))
    turn = F.col("place") % 3
    kind = F.when(F.col("part").startswith("://"), "login").when(F.col("part").rlike(_WORDS), "named")
    each = each.filter((F.col("place") > 0) | (F.octet_length("part") < F.col("whole"))).select(
        "id", "row", "path", "place", F.when(turn == 2, F.col("part")).alias("candidate"), F.length("part").alias("length"), F.when(turn == 1, kind).alias("kind"),
        F.right("part", F.lit(BEFORE)).alias("tail"), F.left("part", F.lit(AFTER)).alias("head"),
    )
    by_text = Window.partitionBy("row").orderBy("place")
    joined = lambda column, first, last: F.array_join(F.collect_list(column).over(by_text.rowsBetween(first, last)), "")
    each = each.withColumn("before", F.right(joined("tail", -3 * BEFORE, -1), F.lit(BEFORE))).withColumn("after", F.left(joined("head", 1, 3 * AFTER), F.lit(AFTER)))
    each = each.withColumns({"start": F.sum("length").over(by_text) - F.col("length"), "announced": F.lag("kind").over(by_text)}).filter(F.col("candidate").isNotNull())
    return each.select("id", F.floor(F.col("place") / 3).cast("int").alias("ordinal"), "start", "candidate", "before", "after", "path", "announced")


def labelled_findings(spark: SparkSession, n: int = 6000, seed: int = 1) -> DataFrame:
    """n labelled findings formed by rule, half of them keys: candidate, before, after, path, label.

    Keys: hexadecimal, base64 and mixed values and provider prefixes behind a key's name in several notations, short ones
    and ones with other signs, JWTs, private keys in PEM, and passwords in URLs.
    Others: digests behind their names, digits, UUIDs, identifiers and paths of dictionary words, rules of signs,
    placeholders behind a key's name, inline images, digests in running text, keys' names of 16 and more characters,
    and words, calls and placeholders where a value or a URL's password would be.
    """
    ids = spark.range(n)

    def written(**columns: Column) -> list[Column]:
        """The columns, computed once: what is formed of them stays small enough to plan and compile."""
        nonlocal ids
        ids = materialise(ids.select("*", *[c.alias(k) for k, c in columns.items()]))
        return [F.col(k) for k in columns]

    pick = lambda salt, *options: F.element_at(F.array(*[F.lit(o) if isinstance(o, str) else o for o in options]), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(options))) + 1).cast("int"))
    hexes = F.sha2(F.concat_ws("-", F.col("id"), F.lit(seed)), 512)
    mixed = F.regexp_replace(F.base64(F.unhex(hexes)), r"\s", "")
    chosen = lambda i: F.element_at(F.array(*[F.lit(w) for w in DICTIONARY]), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(100 + i)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    hexes, mixed, *_ = written(hexes=hexes, mixed=mixed, **{f"word{i}": chosen(i) for i in range(1, 8)})
    word = lambda i: F.col(f"word{i}")
    cut = lambda x, *sizes: F.left(x, pick(55, *[F.lit(s) for s in sizes]))
    digits = F.regexp_replace(hexes, "[a-f]", "")
    hex_any = pick(2, cut(hexes, 32, 40, 64, 22, 24), F.upper(cut(hexes, 32, 40, 64)))
    key = pick(3, hex_any, hex_any, hex_any, cut(mixed, 20, 24, 32, 40, 64), cut(F.regexp_replace(mixed, "[+/=]", "x"), 20, 32, 36, 48), F.concat(pick(4, "sk_live_", "ghp_", "glpat-", "xoxb-", "AKIA", "AIza", "eyJ"), cut(F.regexp_replace(mixed, "[+/=]", "9"), 16, 24, 36)))
    name = pick(5, "token", "TOKEN", "api_key", "apikey", "secret", "client_secret", "password", "access_token", "auth_token", "private_key", "AWS_SECRET_ACCESS_KEY", "Token", "API_KEY", "passwd", "passphrase", "db_pass", F.concat(word(4), F.lit("_secret_of_the_"), word(5), F.lit("_"), word(6)))
    long_name = pick(21, "AWS_SECRET_ACCESS_KEY", "aws_secret_access_key", "stripe_secret_key", "github_access_token", "DATABASE_PASSWORD", F.concat(word(4), F.lit("_"), name, F.lit("_"), word(5), F.lit("_"), word(6)), F.concat_ws("_", word(4), word(5), word(6), word(7)))
    prose = F.concat(pick(11, "", ". ", "### ", ", ", "\n", "!! "), word(1), F.lit(" "), pick(12, word(2), F.upper(word(2)), F.lit("de la"), F.lit("le ua")), F.lit(" "))
    sign = pick(6, ' = "', '="', ": ", ": '", "=", ' := "', ' = &quot;', "='", '": "', ">")
    close = F.when(sign.contains('"'), '"').when(sign.contains("'"), "'").when(sign.contains("&"), "&quot;").when(sign == ">", "</").otherwise(F.lit(" "))
    key, name, long_name, prose, sign, close, hex_any = written(key=key, name=name, long_name=long_name, prose=prose, sign=sign, close=close, hex_any=hex_any)
    named = F.struct(key.alias("candidate"), F.concat(prose, name, sign).alias("before"), F.concat(close, F.lit(" "), word(3)).alias("after"))
    finding = lambda c, before, after="": F.struct(c.alias("candidate"), (before if isinstance(before, Column) else F.lit(before)).alias("before"), (after if isinstance(after, Column) else F.concat(F.lit(after), F.lit(" "), word(3))).alias("after"))
    plain = F.regexp_replace(mixed, "[+/=]", "x")
    short = pick(23, F.left(plain, F.lit(8)), F.left(plain, F.lit(10)), F.left(plain, F.lit(12)), F.left(hexes, F.lit(14)), F.concat(word(4), F.left(digits, F.lit(4))), F.concat(word(4), F.lit("!"), F.left(plain, F.lit(5))))
    signed = F.concat(F.left(plain, F.lit(7)), pick(24, ".", "~", "!", "$", "@", "#"), F.substring(plain, 8, 9), pick(25, ".", "~", "!", "$", "@"), F.substring(plain, 17, 11))
    web = F.translate(mixed, "+/=", "-_x")
    jwt = F.concat(F.lit("eyJ"), F.left(web, F.lit(17)), pick(26, ".eyJ", "."), F.substring(web, 18, 40), F.lit("."), F.substring(web, 40, 43))
    kind = pick(27, "", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED ")
    pem = F.concat(F.lit("-----BEGIN "), kind, F.lit("PRIVATE KEY-----\n"), F.left(mixed, F.lit(64)), F.lit("\n"), F.repeat(F.concat(F.substring(mixed, 9, 64), F.lit("\n")), pick(28, *[F.lit(n) for n in (1, 3, 12, 25)])), F.lit("-----END "), kind, F.lit("PRIVATE KEY-----"))
    login = F.concat(prose, pick(29, "postgres", "https", "mongodb+srv", "amqp", "redis"), F.lit("://"), pick(30, word(4), "", "root"), F.lit(":"))
    host = F.concat(F.lit("@"), word(5), pick(31, ".example.org/", ":5432/", "/"), word(6))
    short, signed, jwt, pem, login, host = written(short=short, signed=signed, jwt=jwt, pem=pem, login=login, host=host)
    yes = pick(
        32, named, named, named, named, named, named, named, named,
        finding(pick(33, short, signed), F.concat(prose, name, sign), close), finding(pick(33, short, signed), F.concat(prose, name, sign), close),
        finding(jwt, prose, pick(40, ".", "", " ")), finding(jwt, pick(34, prose, F.concat(prose, name, sign), F.concat(prose, F.lit("Authorization: Bearer ")))), finding(pem, pick(35, prose, F.concat(prose, name, sign))),
        finding(pick(36, short, short, signed, F.left(plain, F.lit(20)), F.left(plain, F.lit(5)), F.concat(plain, signed), F.repeat(signed, F.lit(8))), login, host),
    )
    joint = pick(7, "_", "-", "")
    identifier = F.concat(word(4), joint, F.initcap(word(5)), joint, word(6), joint, F.initcap(word(7)))
    no = pick(
        8,
        finding(hex_any, F.concat(prose, pick(9, "commit ", "sha256: ", "md5 = ", "checksum=", "revision ", "etag: \"", "integrity: ", "hash "))),
        finding(hex_any, prose),
        finding(cut(digits, 16, 18, 20), prose),
        finding(cut(digits, 16, 18, 20), F.concat(prose, pick(10, "order: ", "id = ", "serial ", "phone: ", "isbn "))),
        finding(F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)), F.concat(prose, pick(13, "uuid = \"", "id: ", ""))),
        finding(identifier, F.concat(prose, pick(14, "", "class ", "def ", "= ", "import "))),
        finding(F.concat_ws("/", word(4), word(5), word(6), word(7)), F.concat(prose, pick(15, "https://example.org/", "/", "./", "href=\"/")), pick(16, ".html", ".py", "/", "")),
        finding(F.repeat(pick(17, "-", "=", "_", "+", "/", "ab"), 24), prose),
        finding(pick(18, F.concat(F.lit("your_"), word(4), F.lit("_"), word(5), F.lit("_here")), F.lit("xxxxxxxxxxxxxxxxxxxxxxxx"), F.lit("EXAMPLE_KEY_0000000000000000"), F.lit("change_me_please_now"), F.concat(F.lit("insert_"), word(4), F.lit("_token_here"))), F.concat(prose, name, sign), close),
        finding(cut(mixed, 40, 64, 80), F.concat(prose, F.lit("data:image/png;base64,"))),
        finding(F.concat(word(4), word(5), word(6)), prose),
        finding(long_name, F.concat(prose, pick(22, "", '"', "export ", "?")), F.concat(sign, F.left(hexes, F.lit(20)))),
        finding(pick(37, F.concat(word(4), pick(38, "-", "_", "/", ""), word(5), word(6)), F.concat(word(4), F.lit("."), word(5), F.lit("_"), word(6)), F.concat(word(4), F.lit("("), word(5), F.lit("."), word(6)), F.concat(F.lit("${"), F.upper(word(4)), F.lit("_"), F.upper(word(5)), F.lit("}")), F.lit("required"), F.lit("********")), F.concat(prose, name, sign), close),
        finding(pick(39, "password", "your_password", "changeme", "xxxxxxxx", "********", "${PASSWORD}", "<password>"), login, host),
        finding(F.concat(F.lit("eyJ"), word(4), F.lit("."), word(5), F.lit("."), word(6)), prose),
    )
    label = F.pmod(F.col("id"), F.lit(2)).cast("double")
    path = F.when(label == 1, pick(19, "src1", "src12", "app/config.py", "deploy/prod.env", "README.md", "tests/fixtures/data.json", "", "page.html")).otherwise(pick(20, "src1", "src12", "app/config.py", "docs/guide.md", "README.md", "tests/fixtures/data.json", "", "page.html"))
    rows = ids.select(label.alias("label"), F.when(label == 1, yes).otherwise(no).alias("f"), path.alias("path"))
    return rows.select("f.*", "path", "label").filter((F.length("candidate") >= 8) | F.col("before").rlike("://[^ ]*:$"))


def train(findings: DataFrame, trees: int = 30, depth: int = 9, seed: int = 17) -> PipelineModel:
    """A forest over FEATURES from labelled findings: candidate, before, after, path, label. Their number is the caller's bound."""
    gathered = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features", probabilityCol="chances")
    # Written in two steps: the forest reads its rows several times, and each step's code stays small enough to compile.
    ready = gathered.transform(materialise(with_features(materialise(findings)))).select("features", "label")
    return PipelineModel([gathered, forest.fit(ready)])


def scan(docs: DataFrame, model: PipelineModel | None = None, threshold: float = 0.5, keep_rejected: bool = False, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row a finding: id, ordinal, start (characters from 0), length, secret_sha256, key_word, score, is_secret.

    Each whole text is searched for CANDIDATE; the forest scores every candidate from its length, character
    transitions, share of dictionary words, path and neighbouring words, and those below the threshold go unless
    `keep_rejected` asks for them. Without a model one is trained from `labelled_findings`. The secret itself is not
    returned, only its digest. Texts without a candidate leave the plan at the scan.

    Values behind a key's name count from 8 characters on, in quotes only without blanks; other runs from 16 on. There
    is no greatest length, for names, values, logins or keys.

    Null and empty texts have no findings. Null ids and paths pass. Repeated rows have findings of their own. An empty
    table gives no rows. Extra columns are ignored. Long texts are searched whole.
    """
    path_col = path_col if path_col in docs.columns else None
    model = model or train(labelled_findings(docs.sparkSession))
    scored = model.transform(with_features(candidates(docs, id_col, text_col, path_col))).withColumn("score", vector_to_array("chances")[1])
    is_secret = F.col("score") >= threshold
    out = scored if keep_rejected else scored.filter(is_secret)
    return out.select(F.col("id").alias(id_col), F.col("ordinal").cast("int"), F.col("start").cast("long"), F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("secret_sha256"), (F.col("key_word") > 0).alias("key_word"), F.round("score", 6).alias("score"), is_secret.alias("is_secret"))
