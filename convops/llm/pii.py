"""Personal data replaced by keyed surrogates, with DataFrame functions only.

Entities (email, phone, IPv4 address, card number, social security number, secret, access key, titled name) are found by
regular expressions. Each distinct entity of the corpus, in a canonical form that joins its spellings, gets a surrogate
of its own type: a keyed hash chosen character by character in the entity's format (letters for letters, hex for hex,
digits for digits, valid octets, a check digit where the original has one). Candidates that equal another entity's
surrogate or any entity of the corpus are drawn again until none collides, so distinct entities stay distinct and equal
ones equal over the whole corpus. Each mention is rendered in its own spelling.

Names have two parts that are entities of their own: given names (by gender of the title and by script) and the family
name (by script), the last word after the title. So "Mr John Smith" and "Mr Smith" agree. A full name that stands after
a title somewhere in a document is replaced where it stands without one in that document too.

Spaces can be small (private addresses, numbers of a fixed length). From the ``WIDER``-th attempt on addresses leave
their private block and local parts of email addresses grow by a letter an attempt; from the ``LAST``-th on addresses
are drawn from all, and numbers, secrets and keys grow by a character an attempt. So attempts end.

Only documents with entities are shuffled; mentions meet their surrogates in a join whose skewed partitions Spark
splits, and the entity table is combined before its shuffle, so an entity in a third of all documents is harmless.

Defined cases: null text stays null, texts without entities are returned unchanged; repeated rows are treated alike;
ids may be null or repeated, rows are told apart by their place in storage; all columns of the input are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convops.llm.exact_dedup import located
from convops.llm.shared import discard, documents, stored

KEY = "surrogates-1"

# Titles with their gender and script, and given names by both.
TITLES = {"mr": ("m", "latin"), "mister": ("m", "latin"), "sir": ("m", "latin"), "lord": ("m", "latin"),
          "herr": ("m", "latin"), "herrn": ("m", "latin"), "señor": ("m", "latin"), "monsieur": ("m", "latin"),
          "mrs": ("f", "latin"), "ms": ("f", "latin"), "miss": ("f", "latin"), "madam": ("f", "latin"),
          "lady": ("f", "latin"), "frau": ("f", "latin"), "señora": ("f", "latin"), "señorita": ("f", "latin"),
          "madame": ("f", "latin"), "mme": ("f", "latin"), "mademoiselle": ("f", "latin"),
          "dr": ("n", "latin"), "prof": ("n", "latin"), "doctor": ("n", "latin"), "professor": ("n", "latin"),
          "господин": ("m", "cyrillic"), "госпожа": ("f", "cyrillic"), "доктор": ("n", "cyrillic"),
          "профессор": ("n", "cyrillic")}
GIVEN = {("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marc Nils Otto Paul".split(),
         ("f", "latin"): "Anna Berta Clara Diana Emma Flora Greta Helen Ida Julia Karla Laura Maria Nina Olga Rosa".split(),
         ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел Роман Тимур Фёдор Юрий".split(),
         ("f", "cyrillic"): "Алла Вера Галина Дарья Елена Жанна Зоя Инна Кира Лидия Мария Нина Ольга Раиса Софья Юлия".split()}
GIVEN |= {("n", script): GIVEN["m", script][::2] + GIVEN["f", script][::2] for script in ("latin", "cyrillic")}
#: Last letters of given names that are made of syllables.
ENDINGS = {("m", "latin"): "n", ("f", "latin"): "a", ("n", "latin"): "e",
           ("m", "cyrillic"): "н", ("f", "cyrillic"): "а", ("n", "cyrillic"): "е"}
SYLLABLES = {"latin": "ba ce di fo gu ha je ki lo mu na pe ri so tu va".split(),
             "cyrillic": "ба ве ги до жу за ке ли мо ну па ре си то фу ха".split()}

WIDER, LAST = 4, 8
_TITLE = "(?iu:%s)" % "|".join(sorted(TITLES, key=len, reverse=True))
_PART = "\\p{Lu}\\p{L}*(?:['\u2019-]\\p{L}+)*"
_NAME = f"{_TITLE}\\.? {_PART}(?: {_PART}){{0,2}}"
_PATTERNS = {
    "secret": "(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|auth[_-]?key)\\s{0,3}[=:]\\s{0,3}[\"']?"
              "[A-Za-z0-9_/+=.~!@#$%^&*-]{8,}",
    # keys that show by their own form
    "key": "(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}"
           "|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{5,})(?![A-Za-z0-9])",
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+",
    "name": "(?<![\\p{L}\\p{N}])" + _NAME,
    "ip": "(?<![\\d.])(?:(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)\\.){3}(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)(?!\\d|\\.\\d)",
    "ssn": "(?<![\\d-])\\d{3}-\\d{2}-\\d{4}(?![\\d-])",
    "phone": "\\+1[ .-]?(?:\\(\\d{3}\\)|\\d{3})[ .-]?\\d{3}[ .-]?\\d{4}(?!\\d)"
             "|\\+(?!1[ (.-])\\d{1,3}[ -]?(?:\\(\\d{1,4}\\)|\\d{1,4})(?:[ -]?\\d{2,4}){2,4}(?![\\d.]\\d|\\d)"
             "|(?<![\\d.])\\(\\d{3}\\) ?\\d{3}[ .-]\\d{4}(?!\\d)|(?<![\\d.-])\\d{3}[.-]\\d{3}[.-]\\d{4}(?![\\d.-]\\d)",
    "card": "(?<![\\d.-])\\d{4}(?:[ -]?\\d{4}){2}[ -]?\\d{1,7}(?!\\d)",
}
ENTITY = "|".join(f"(?:{p})" for p in _PATTERNS.values())
#: No text without a match has an entity; one pass over a character class and the titles.
_HINT = "[0-9@]|(?i:passw|pwd|token|secret|[_-]?key)|AKIA|ASIA|gh[pousr]_|sk-|xox|eyJ|(?<!\\p{L})" + _TITLE + "\\.? \\p{Lu}"
_VALUE = "^(.*?[=:]\\s{0,3}[\"']?)(.*)$"


def has_entity(text: Column) -> Column:
    return F.coalesce(text.rlike(_HINT) & text.rlike(ENTITY), F.lit(False))


def entity_type(mention: Column) -> Column:
    out = F.lit("card")
    for name in ("phone", "ssn", "ip", "name", "email", "key", "secret"):
        out = F.when(mention.rlike(f"^(?:{_PATTERNS[name]})$"), F.lit(name)).otherwise(out)
    return out


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "\\D", "")


def parts(kind: Column, mention: Column) -> Column:
    """(kind, value, word) of what a mention is made of, in a form that joins all spellings: itself, or the words of a
    name."""
    value = (F.when(kind == "email", F.lower(mention)).when(kind.isin("phone", "card", "ssn"), _digits(mention))
             .when(kind == "secret", F.regexp_extract(mention, _VALUE, 2)).otherwise(mention))
    title = F.lower(F.regexp_extract(mention, "^(\\p{L}+)", 1))
    group, script = (reduce(lambda rest, t: F.when(title == t, F.lit(of(TITLES[t]))).otherwise(rest), TITLES, F.lit(""))
                     for of in ("/".join, lambda g: g[1]))
    words = F.split(F.regexp_replace(mention, "^\\p{L}+\\.? ", ""), " ")

    def part(word: Column, i: Column) -> Column:
        last = i == F.size(words) - 1
        return F.struct(F.when(last, F.lit("family")).otherwise(F.lit("given")).alias("kind"),
                        F.concat_ws(":", F.when(last, script).otherwise(group), F.lower(word)).alias("value"),
                        word.alias("word"))
    return F.when(kind == "name", F.transform(words, part)).otherwise(
        F.array(F.struct(kind.alias("kind"), value.alias("value"), mention.alias("word"))))


def _draw(stream: Column, i: Column, n: int) -> Column:
    """The i-th number below n of a stream of 128 hex digits; later rounds are shifted."""
    at = (i % 60) * 2
    return (F.conv(F.substring(stream, (at + 1).cast("int"), F.lit(4)), 16, 10).cast("int")
            + F.floor(i / 60).cast("int") * 7) % n


def _spelled(value: Column, stream: Column) -> Column:
    """A letter for each letter, a digit for each digit, everything else as it is."""
    def one(c: Column, i: Column) -> Column:
        return (F.when(c.rlike("[0-9]"), _draw(stream, i, 10).cast("string"))
                .when(c.rlike("[a-z]"), F.char(_draw(stream, i, 26) + 97))
                .when(c.rlike("[A-Z]"), F.char(_draw(stream, i, 26) + 65)).otherwise(c))
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _check_sum(digits: Column) -> Column:
    """Sum of a card number's digits, every second one from the right doubled."""
    def add(total: Column, pair: Column) -> Column:
        d = pair["d"].cast("int") * pair["w"]
        return total + F.when(d > 9, d - 9).otherwise(d)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.alias("d"), (i % 2 + 1).alias("w")))
    return F.aggregate(F.filter(each, lambda p: p["d"] != ""), F.lit(0), add)


def candidate(kind: Column, value: Column, attempt: int, key: str) -> Column:
    """The surrogate drawn for a canonical value at this attempt."""
    def stream(*what: Column) -> Column:
        return F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit(str(attempt)), *what), 512)
    s = stream(kind, value)
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    host, top = F.regexp_extract(domain, "^(.*)\\.", 1), F.substring_index(domain, ".", -1)
    # one surrogate domain for all addresses of a domain: drawn from the domain alone
    same_domain = F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit("domain"), domain), 512)
    longer = F.concat(*(F.char(_draw(s, F.lit(i + 40), 26) + 97) for i in range(max(0, attempt - WIDER + 1))), F.lit(""))
    email = F.concat(_spelled(local, s), longer, F.lit("@"), _spelled(host, same_domain), F.lit("."), top)
    drawn = F.concat(F.substring(value, 1, 1), F.array_join(F.transform(
        F.split(F.substring(value, 2, 64), ""), lambda c, i: F.when(c == "", c).otherwise(
            _draw(s, i, 10).cast("string"))), ""))
    more = F.concat(*(_draw(s, F.lit(i + 20), 10).cast("string") for i in range(max(0, attempt - LAST + 1))), F.lit(""))
    drawn = F.concat(drawn, more)
    body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    check = ((10 - _check_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    card = F.when(_check_sum(value) % 10 == 0, F.concat(body, check)).otherwise(drawn)
    octets = F.split(value, "\\.")
    ten, own = octets[0] == "10", (octets[0] == "192") & (octets[1] == "168")
    first, second = ((_draw(s, F.lit(i), n) + 1).cast("string") for i, n in ((0, 222), (1, 254)))
    if attempt < LAST:
        first = F.when(ten | own, octets[0] if attempt < WIDER else F.lit("10")).otherwise(first)
    if attempt < WIDER:
        second = F.when(own, octets[1]).otherwise(second)
    ip = F.concat_ws(".", first, second, *((_draw(s, F.lit(i), 254) + 1).cast("string") for i in (2, 3)))
    hexed = F.substring(F.concat(s, F.sha2(s, 512), F.sha2(F.sha2(s, 512), 512)), F.lit(1), F.length(value))
    secret = F.when(value.rlike("^[0-9a-f]{8,384}$"), hexed).otherwise(_spelled(value, s))
    own_key = F.concat(F.substring(value, 1, 4), _spelled(F.substring(value, 5, 1 << 20), s))
    word = F.substring_index(value, ":", -1)

    def syllables(script: str, n: int, at: int = 0) -> Column:
        some = F.array(*map(F.lit, SYLLABLES[script]))
        return F.concat(*(F.element_at(some, _draw(s, F.lit(2 * i + at), 16) + 1) for i in range(n)))

    def given(group: tuple[str, str]) -> Column:
        if attempt == 0:
            return F.lower(F.element_at(F.array(*map(F.lit, GIVEN[group])), _draw(s, F.lit(0), 16) + 1))
        return F.concat(syllables(group[1], 1 + attempt), F.lit(ENDINGS[group]))

    def family(script: str) -> Column:
        whole = syllables(script, 4 + attempt)
        return (F.when(word.contains("-"), F.concat(syllables(script, 2 + attempt), F.lit("-"), syllables(script, 2, 31)))
                .when(word.rlike("^\\p{L}['\u2019]"), F.concat(F.substring(word, 1, 2), whole)).otherwise(whole))
    names = F.lit(None).cast("string")
    for g in GIVEN:
        names = F.when(value.startswith("/".join(g) + ":"), F.concat(F.lit("/".join(g) + ":"), given(g))).otherwise(names)
    for script in SYLLABLES:
        names = F.when(value.startswith(script + ":"), F.concat(F.lit(script + ":"), family(script))).otherwise(names)
    return (F.when(kind == "email", email).when(kind.isin("phone", "ssn"), drawn).when(kind == "card", card)
            .when(kind == "ip", ip).when(kind == "secret", F.concat(secret, more))
            .when(kind == "key", F.concat(own_key, more)).otherwise(names))


def render(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's (or name part's) own spelling: separators, case, key and quote stay."""
    def place(c: Column, i: Column) -> Column:
        before = _digits(F.substring(mention, F.lit(1), i))
        return F.when(c.rlike("[0-9]"), F.substring(surrogate, F.length(before) + 1, F.lit(1))).otherwise(c)
    more = F.substring(surrogate, F.length(_digits(mention)) + 1, F.lit(1 << 20))  # digits that a long one has more
    placed = F.concat(F.array_join(F.transform(F.split(mention, ""), place), ""), more)
    return (F.when(kind.isin("phone", "card", "ssn"), placed)
            .when(kind == "email", F.when(mention == F.upper(mention), F.upper(surrogate)).otherwise(surrogate))
            .when(kind == "secret", F.concat(F.regexp_extract(mention, _VALUE, 1), surrogate))
            .when(kind.isin("given", "family"), _cased(F.substring_index(surrogate, ":", -1), mention))
            .otherwise(surrogate))


def _cased(name: Column, like: Column) -> Column:
    """A name in capitals if ``like`` is, else with a capital at the start and after each hyphen and apostrophe."""
    capital = name
    for mark in ("-", "'", "\u2019"):
        capital = F.array_join(F.transform(F.split(capital, mark), lambda w: F.concat(
            F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), mark)
    return F.when((like == F.upper(like)) & (F.length(like) > 1), F.upper(name)).otherwise(capital)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, value, surrogate for distinct (kind, value); no surrogate is another's, or any value of its kind."""
    entities = stored(entities.distinct(), "pii-entities")
    pending, done, attempt = entities, [], 0
    while True:
        drawn = pending.withColumn("surrogate", candidate(F.col("kind"), F.col("value"), attempt, key))
        taken = entities.select("kind", F.col("value").alias("surrogate"))
        for d in done:
            taken = taken.unionByName(d.select("kind", "surrogate"))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        won = stored(first.join(taken, ["kind", "surrogate"], "left_anti"), "pii-surrogates")
        done.append(won.select("kind", "value", "surrogate"))
        pending = stored(pending.join(won, ["kind", "value"], "left_anti"), "pii-pending")
        attempt += 1
        if not pending.take(1):
            discard(entities.sparkSession, entities, pending)
            return reduce(DataFrame.unionByName, done)


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(row: all columns of ``docs``, text with surrogates, entities replaced)."""
    rows = located(docs).withColumn("found", has_entity(F.col("row.text").cast("string")))
    clean = rows.where(~F.col("found")).select("row", F.col("row.text").cast("string").alias("text"),
                                               F.lit(0).alias("entities"))
    marked = rows.where("found").select("row", "file", "at")
    mention = (marked.select("file", "at", F.posexplode(F.regexp_extract_all("row.text", F.lit(ENTITY), F.lit(0)))
                             .alias("pos", "mention"))
               .withColumn("type", entity_type(F.col("mention")))
               .select("file", "at", "pos", "type", "mention", F.posexplode(parts(F.col("type"), F.col("mention")))
                       .alias("part", "of")).select("file", "at", "pos", "type", "mention", "part", "of.*"))
    mention = stored(mention, "pii-mentions")
    pairs = surrogates(mention.select("kind", "value"), key)
    word = F.struct("part", render(F.col("kind"), F.col("word"), F.col("surrogate")).alias("now"), "word")
    # all words of a mention and all mentions of a document lie in one partition
    whole = (mention.join(pairs, ["kind", "value"]).repartition("file", "at").groupBy("file", "at", "pos")
             .agg(F.sort_array(F.collect_list(word)).alias("words"), F.first("type").alias("type"),
                  F.first("mention").alias("mention")))
    title = F.when(F.col("type") == "name", F.regexp_extract("mention", "^(\\p{L}+\\.? )", 1)).otherwise("")
    now = F.array_join("words.now", " ")
    full = F.when((F.col("type") == "name") & (F.size("words") > 1),
                  F.struct((-F.length("mention")).alias("size"), F.array_join("words.word", " ").alias("name"), now.alias("now")))
    by_doc = (whole.select("file", "at", F.struct("pos", F.concat(title, now).alias("now")).alias("one"), full.alias("full"))
              .groupBy("file", "at").agg(F.sort_array(F.collect_list("one")).alias("all"),
                                         F.sort_array(F.collect_set("full")).alias("names")))

    def untitled(segment: Column) -> Column:
        """Full names of the document that stand without a title, longer ones first."""
        def one(text: Column, name: Column) -> Column:
            return F.regexp_replace(text, F.concat(F.lit("(?<![\\p{L}\\p{N}])\\Q"), name["name"],
                                                   F.lit("\\E(?![\\p{L}\\p{N}])")), name["now"])
        return F.when(F.size("names") > 0, F.aggregate("names", segment, one)).otherwise(segment)
    between = F.split(F.col("row.text"), ENTITY, -1)
    text = F.array_join(F.zip_with(between, F.col("all.now"), lambda a, b: F.concat(untitled(a), F.coalesce(b, F.lit("")))), "")
    dirty = marked.join(by_doc, ["file", "at"]).select("row", text.alias("text"), F.size("all").alias("entities"))
    return clean.unionByName(dirty)


def replaced_rows(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with its columns, surrogates in the text."""
    return replace(docs, key).select(*(F.col("text").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c)
                                       for c in docs.columns))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(documents(spark, sf_dir)).select("row.doc_id", "text", "entities")
