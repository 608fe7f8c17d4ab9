"""Variant spellings of people's names, linked to the person they mean.

Every typed name is rewritten by rules (case, accents, titles and legal forms, particles, initials, order of the parts); a nickname
stands for each full name it may be short for.  All rewritings are exploded to *forms*, which also survive a typing error (a letter
left out), an initial or a missing birth date.  Rows with equal forms meet in an equi-join; a pair counts by what agrees and by how
rare its rarest shared form is.  Rows with a birth date and a full given name are linked first; rows that lack
either join a person only if exactly one person fits best, because different people share names and birth dates.

The forms are joined from the telling to the common: dated ones, then full names, and only for rows that no person's full name fits,
surname and initial.  What such a common form could find beside a better one would never count, so nothing is lost, and a surname
that many people share is not joined with itself.  Equal spellings are one node, so that copies don't multiply.
Steps write their tables and none is broadcast: however many joins there are, the driver holds the plan of one step and no rows.

Defined results: null or blank names link to nothing; equal names without a birth date are linked only if no two persons
of that name are told apart by birth dates; repeated rows of an id count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.session import cut, cut_counted, modest_broadcasts

# Familiar forms of given names; some stand for several names.
NICKNAMES = {
    "abigail": ["abby", "gail"], "agnieszka": ["aga"], "alexander": ["alex", "sascha", "sasha", "xander"], "andrew": ["andy", "drew"], "anthony": ["tony"], "barbara": ["babs", "barb"],
    "benjamin": ["ben", "benny"], "charles": ["charlie", "chuck"], "christopher": ["chris", "kit"], "concepcion": ["concha", "conchita"], "daniel": ["dan", "danny"], "deborah": ["debbie", "deb"], "dmitri": ["dima"],
    "dolores": ["lola", "lolita"], "dorothy": ["dolly", "dot", "dottie"], "eduardo": ["lalo", "edu"], "edward": ["eddie", "ed", "ned", "ted", "teddy"], "ekaterina": ["katya"], "elisabetta": ["betta"],
    "elizabeth": ["beth", "betty", "liz", "lizzie", "eliza"], "enrique": ["quique", "kike"], "francisco": ["paco", "pancho", "curro"], "friedrich": ["fritz"], "giuseppe": ["beppe", "peppino", "peppe"],
    "guadalupe": ["lupe", "lupita"], "heinrich": ["heiner", "heinz"], "ignacio": ["nacho"], "jacqueline": ["jackie"], "james": ["jim", "jimmy"], "jennifer": ["jenny", "jen"], "johannes": ["hannes", "hans"],
    "john": ["jack", "johnny"], "josef": ["jupp", "sepp"], "joseph": ["joe", "joey"], "katarzyna": ["kasia"], "katherine": ["kate", "kathy", "kitty", "katie"], "magdalena": ["leni", "magda"],
    "malgorzata": ["gosia"], "margaret": ["maggie", "meg", "peggy"], "matthew": ["matt"], "michael": ["mick", "mike"], "nikolai": ["kolya"], "patricia": ["patty", "trish", "pat"], "penelope": ["penny"],
    "rebecca": ["becky"], "richard": ["dick", "rick", "rich"], "robert": ["bob", "bobby", "rob"], "samuel": ["sam", "sammy"], "sebastian": ["basti"], "stanislaw": ["staszek"], "susan": ["sue", "suzy"],
    "theodore": ["theo"], "thomas": ["tom", "tommy"], "ulrike": ["uli", "ulla"], "victoria": ["vicky"], "virginia": ["ginny"], "vladimir": ["vova", "volodya"], "wilhelmina": ["minna", "willa"],
    "alan": ["al"], "albert": ["al", "bert", "bertie"], "alexandra": ["alex", "sandra", "sasha"], "alfred": ["alf", "fred"], "arthur": ["art"], "catherine": ["cathy", "kate"], "christine": ["chris", "chrissie", "tina"],
    "david": ["dave", "davy"], "donald": ["don", "donnie"], "douglas": ["doug"], "eugene": ["gene"], "frederick": ["fred", "freddie"], "gerald": ["gerry", "jerry"], "gregory": ["greg"], "harold": ["harry", "hal"], "henry": ["harry", "hank"],
    "jeffrey": ["jeff"], "jonathan": ["jon"], "joshua": ["josh"], "kenneth": ["ken", "kenny"], "lawrence": ["larry"], "leonard": ["len", "lenny"], "nathaniel": ["nat", "nate"], "nicholas": ["nick", "nicky"], "patrick": ["pat", "paddy"],
    "peter": ["pete"], "philip": ["phil"], "raymond": ["ray"], "ronald": ["ron", "ronnie"], "samantha": ["sam", "sammy"], "stephen": ["steve"], "steven": ["steve"], "timothy": ["tim"], "walter": ["walt", "wally"],
    "william": ["bill", "billy", "will"], "yevgenia": ["zhenya"], "zbigniew": ["zbyszek"],
}

# Parts that are no part of the name proper.
PARTICLES = {"van", "von", "de", "la", "der", "den", "del", "della", "di", "da", "dos", "al", "el", "mc", "mac", "bin", "ibn", "le", "du", "zu", "ter", "ten"}
TITLES = {"dr", "prof", "mr", "mrs", "ms", "miss", "herr", "frau", "sir", "dame", "md", "phd", "jr", "sr", "ii", "iii", "iv", "dipl", "ing", "inc", "ltd", "gmbh", "llc", "ag"}

ALIAS = re.compile(r"\(+([^()]*)\)*")
DIGRAPHS = re.compile("([aou])e")
NOT_WORD = re.compile(r"[^\w\s,-]+|_")


def plain(text: str | None) -> str:
    """Lower case without accents; umlauts and their two-letter spellings alike."""
    t = (text or "").casefold().replace("ß", "ss").replace("ł", "l").replace("ø", "o")
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def full_names(nicknames: dict[str, list[str]] = NICKNAMES) -> dict[str, list[str]]:
    """Nickname to the canonical full names it may stand for."""
    found: dict[str, list[str]] = {}
    for full, nicks in nicknames.items():
        for nick in nicks:
            found.setdefault(core(nick), []).append(core(full))
    return found


def core(token: str) -> str:
    return DIGRAPHS.sub(r"\1", token)


def _tokens(text: str) -> list[str]:
    found = [t for t in NOT_WORD.sub(" ", text).replace("-", "").split() if t not in TITLES]
    return [t for t in found if t not in PARTICLES] or found


def canonical(last: str | None, first: str | None, middle: str | None) -> tuple[str, str, str]:
    """(surname, given name, middle name) by the order rules, each possibly empty."""
    last, first, middle = plain(last), plain(first), plain(middle)
    aliases = [_tokens(a) for a in ALIAS.findall(last) + ALIAS.findall(first)]
    alias = next((a[0] for a in aliases if a), "")
    last, first = ALIAS.sub(" ", last), ALIAS.sub(" ", first)
    if not first.strip() or not last.strip():
        whole = last if last.strip() else first
        if "," in whole:
            last, _, first = whole.partition(",")
            given = _tokens(first.replace(",", " "))
            surname = _tokens(last)
        else:
            parts = _tokens(whole)
            surname, given = parts[-1:], parts[:-1]
    else:
        surname, given = _tokens(last.replace(",", " ")), _tokens(first.replace(",", " "))
    name = given[0] if given else ""
    name = name[0] if len(name) > 1 and len(set(name)) == 1 else name  # an initial typed twice
    if len(name) <= 1 and alias:
        name = alias
    rest = _tokens(middle) or given[1:]
    return core("".join(surname)), core(name), core(rest[0]) if rest else ""


def birth_key(text: str | None) -> str:
    """Year and the two smaller parts in rising order, so that exchanged days and months agree; empty if unreadable."""
    digits = re.sub(r"[\s./-]", "", text or "")
    if not re.fullmatch("[0-9]{8}", digits) or not "1800" <= digits[:4] <= "2100":
        return ""
    a, b = sorted((digits[4:6], digits[6:]))
    return f"{digits[:4]}{a}{b}" if "01" <= a <= "12" and b <= "31" else ""


def rewritten(names: DataFrame) -> DataFrame:
    """(name_id, s, g, m, birth, sex) of every row, not yet turned."""
    columns = ["name_id", "last_name", "first_name", "middle_name", "birth_date", "sex"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [batch.column(i).to_pylist() for i in range(1, 5)]
            parts = [canonical(*row) for row in zip(*held[:3], strict=True)]
            s, g, m = (pa.array([p[i] for p in parts], pa.string()) for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), s, g, m, pa.array([birth_key(b) for b in held[3]], pa.string()), batch.column(5)], ["name_id", "s", "g", "m", "birth", "sex"])

    read = names.where("name_id is not null").select(*columns).mapInArrow(run, "name_id bigint, s string, g string, m string, birth string, sex string")
    return read.withColumn("sex", F.when(F.upper(F.trim("sex")).isin("M", "F"), F.upper(F.trim("sex"))).otherwise("")).where("s != '' or g != ''")


def _fulls(token: Column) -> Column:
    """The names a given name may stand for, itself if it is no nickname."""
    table = F.create_map(*[x for nick, fulls in full_names().items() for x in (F.lit(nick), F.array(*map(F.lit, fulls)))])
    return F.coalesce(F.try_element_at(table, token), F.array(token))


def turned(rows: DataFrame) -> DataFrame:
    """Surname and given name exchanged where the corpus uses them the other way round: the rarer reading gives way."""
    tokens = rows.select(F.inline(F.array(F.struct(F.col("s").alias("t"), F.lit(0).alias("as_given")), F.struct(F.col("g").alias("t"), F.lit(1).alias("as_given")))))
    counts = tokens.where("t != ''").groupBy("t").agg(F.sum("as_given").alias("given"), F.sum(1 - F.col("as_given")).alias("last"))
    ratio = counts.select("t", ((F.col("given") + 1) / (F.col("last") + 1)).alias("ratio"))
    both = rows.join(ratio.select(F.col("t").alias("s"), F.col("ratio").alias("s_ratio")), "s", "left").join(ratio.select(F.col("t").alias("g"), F.col("ratio").alias("g_ratio")), "g", "left")
    turn = (F.col("g") != "") & (F.col("s") != "") & (F.col("s_ratio") > F.col("g_ratio"))
    given = F.when(turn, F.col("s")).otherwise(F.col("g"))
    # A nickname of one name is that name; one of several stays, and its forms are exploded.
    one = F.when(F.size(_fulls(given)) == 1, F.get(_fulls(given), F.lit(0))).otherwise(given)
    return both.select("name_id", F.when(turn, F.col("g")).otherwise(F.col("s")).alias("s"), one.alias("g"), "m", "birth", "sex")


def _shorter(c: str) -> Column:
    """A word and all words with one letter left out."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.length(c))))
    return F.array_distinct(F.concat(F.array(c), F.when(F.length(c) >= 4, every).otherwise(F.array().cast("array<string>"))))


def _word(*parts: Column | str) -> Column:
    return F.concat_ws("|", *parts)


def noded(ids: DataFrame) -> DataFrame:
    """Nodes with the first name their surname (``f``) and all names their given name (``gs``) may stand for, and whether nothing is missing."""
    complete = (F.col("birth") != "") & (F.col("s") != "") & (F.length("g") > 1)
    return ids.select("node", "s", "g", "m", "birth", "sex", F.get(_fulls(F.col("s")), F.lit(0)).alias("f"), _fulls(F.col("g")).alias("gs"), complete.alias("strong"))


def dated_forms(nodes: DataFrame) -> DataFrame:
    """(node, form) with a birth date, of every rewriting."""
    first = F.substring("g", 1, 1)
    ends = [_word(F.lit("a"), "birth", F.substring("s", 1, 4), first), _word(F.lit("z"), "birth", F.substring("s", -4, 4), first)]
    # Parts in either order.
    crossed = [_word(F.lit(k), "birth", F.least(F.substring("s", at, 3), F.substring("g", at, 3)), F.greatest(F.substring("s", at, 3), F.substring("g", at, 3))) for k, at in (("p", 1), ("q", -3))]
    each = nodes.where("birth != '' and s != ''").select("node", "s", "birth", F.explode(F.array_distinct(F.concat(F.array("g"), "gs"))).alias("g"))
    ends = F.concat(F.array(*ends), F.when(F.length("g") > 1, F.array(*crossed)).otherwise(F.array().cast("array<string>")))
    return each.select("node", F.explode(F.concat(F.transform(_shorter("s"), lambda v: _word(F.lit("s"), "birth", v)), ends)).alias("form")).distinct()


def full_forms(nodes: DataFrame) -> DataFrame:
    """(node, form) of surname, also with a letter left out, and full given name."""
    each = nodes.where("s != '' and length(g) > 1").select("node", "s", F.explode(F.array_distinct(F.concat(F.array("g"), "gs"))).alias("g"))
    return each.select("node", F.explode(F.transform(_shorter("s"), lambda v: _word(F.lit("n"), v, "g"))).alias("form"))


def initial_forms(nodes: DataFrame) -> DataFrame:
    """(node, form) of surname and initial."""
    return nodes.where("s != '' and g != ''").select("node", _word(F.lit("i"), "s", F.substring("g", 1, 1)).alias("form"))


def _agreement(a: str, b: str) -> Column:
    """3 equal, 2 a typing error apart, 1 an initial or missing, 0 different."""
    x, y = F.col(a), F.col(b)
    short = F.least(F.length(x), F.length(y))
    letters = lambda c: F.array_sort(F.split(c, ""))
    near = (F.levenshtein(x, y) <= F.when(short >= 5, 2).when(short >= 2, 1).otherwise(0)) | ((short >= 3) & (letters(x) == letters(y)))
    initial = (short <= 1) & ((short == 0) | (F.substring(x, 1, 1) == F.substring(y, 1, 1)))
    return F.when((x == y) & (short > 1), 3).when((short > 1) & near, 2).when(initial, 1).otherwise(0)


def shared(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, n): nodes of two sets of forms (node, form) that share one; n counts the nodes that share the rarest.

    Forms that ``a`` does not have are left out of ``b`` before anything is counted or moved again.
    """
    if a is not b:
        b = b.join(a.select("form").distinct(), "form", "left_semi")
    rarity = b.groupBy("form").agg(F.count("*").alias("n"))
    other = b.join(rarity, "form").select("form", F.col("node").alias("b"), "n")
    pairs = a.select("form", F.col("node").alias("a")).join(other, "form").where("a != b")
    return pairs.groupBy("a", "b").agg(F.min("n").alias("n"))


def judged(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b, n) that agree, with ``tier``, ``kg``, ``dated`` and whether either node is strong; higher tiers are better."""
    side = lambda p: nodes.select(*[F.col(c).alias(p if c == "node" else f"{p}_{c}") for c in ("node", "s", "g", "m", "birth", "sex", "f", "gs", "strong")])
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    # A surname may be further off where birth date and given name are equal.
    least = F.least(F.length("a_s"), F.length("b_s"))
    far = (F.levenshtein("a_s", "b_s") <= F.when(least >= 8, 4).when(least >= 6, 3).otherwise(0)) & (F.col("a_birth") != "") & (F.col("a_birth") == F.col("b_birth"))
    alike = (F.length("a_g") > 1) & (F.length("b_g") > 1) & F.arrays_overlap(F.concat("a_gs", F.array("a_g")), F.concat("b_gs", F.array("b_g")))
    full = full.withColumns({"ks": _agreement("a_s", "b_s"), "kg": F.when(alike, 3).otherwise(_agreement("a_g", "b_g")), "km": _agreement("a_m", "b_m"), "xs": _agreement("a_s", "b_g"), "xg": _agreement("a_g", "b_s"), "xn": _agreement("a_f", "b_g"), "xm": _agreement("a_g", "b_f")})
    full = full.withColumns({"ks": F.when((F.col("ks") < 2) & far & (F.col("kg") >= 2), 2).otherwise(F.col("ks")), "xs": F.greatest("xs", "xn"), "xg": F.greatest("xg", "xm")})
    turn = (F.col("xs") >= 2) & (F.col("xg") >= 2) & ((F.col("ks") < 2) | (F.col("kg") < 2))
    full = full.withColumns({"ks": F.when(turn, 2).otherwise(F.col("ks")), "kg": F.when(turn, 2).otherwise(F.col("kg"))})
    same_sex = (F.col("a_sex") == F.col("b_sex")) | (F.col("a_sex") == "") | (F.col("b_sex") == "")
    dated_pair = (F.col("a_birth") != "") & (F.col("a_birth") == F.col("b_birth"))
    undated_pair = (F.col("a_birth") == "") | (F.col("b_birth") == "")
    fine = (F.col("ks") >= 2) & (F.col("kg") >= 1) & (dated_pair | (undated_pair & same_sex & (F.col("km") >= 1) & ((F.col("ks") + F.col("kg") >= 5) | ((F.col("ks") == 3) & (F.col("kg") == 1)))))
    tier = F.col("kg") * 100 + F.col("ks") * 10 + F.col("km") + dated_pair.cast("int") * 1000
    return full.where(fine).select("a", "b", tier.alias("tier"), "n", "kg", dated_pair.alias("dated"), "a_strong", "b_strong")


def components(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, person): the smallest node reachable; labels spread along edges and through the label they reached, in few rounds."""
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(edges.select(F.inline(ways)).distinct())
    label = cut(ids.select("node", F.col("node").alias("person")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "person"), "b").groupBy(F.col("a").alias("node")).agg(F.min("person").alias("near"))
        low = label.join(near, "node", "left").select("node", F.least("person", F.coalesce("near", "person")).alias("low"), "person")
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new, moved = cut_counted(low.join(jump, "low", "left").select("node", F.least("low", F.coalesce("lower", "low")).alias("person"), (F.col("low") != F.col("person")).alias("moved")), "moved")
        label = new.drop("moved")
        if not moved:
            return label


def link(names: DataFrame) -> DataFrame:
    """(name_id, person) of every row with a name; person is the smallest node of the rows linked."""
    with modest_broadcasts(names.sparkSession, "-1"):
        return cut(_linked(names))


def _linked(names: DataFrame) -> DataFrame:
    key = ["s", "g", "m", "birth", "sex"]
    rows = turned(cut(rewritten(names)))
    rows = cut(rows.groupBy("name_id").agg(F.min(F.struct(*key)).alias("v")).select("name_id", "v.*"))
    nodes = cut(noded(rows.groupBy(*key).agg(F.min("name_id").alias("node"))))
    strong, weak = nodes.where("strong"), nodes.where("not strong")
    named = lambda df, c: df.select(F.col("node").alias(c))

    # Dated forms make the persons.
    dated = cut(dated_forms(nodes))
    with_date = cut(judged(shared(dated, dated).where("a < b"), nodes))
    persons = components(with_date.where("dated and kg >= 2 and a_strong and b_strong"), strong.select("node"))

    # Rows without a birth date meet all others over full names, then those that no person fits over initials.
    missing = nodes.where("birth = ''")
    by_name = cut(judged(shared(full_forms(missing), full_forms(nodes)), nodes))
    open_ = cut(missing.join(by_name.where("b_strong").select(F.col("a").alias("node")), "node", "left_anti"))
    by_initial = cut(judged(shared(initial_forms(open_), initial_forms(strong)), nodes))
    # A row that lacks something joins the person that fits best, among equals the one with the rarest shared form, if that is one.
    turned_round = with_date.select(F.col("b").alias("a"), F.col("a").alias("b"), "tier", "n", "kg", "dated", F.col("b_strong").alias("a_strong"), F.col("a_strong").alias("b_strong"))
    ways = with_date.union(turned_round).union(by_name).union(by_initial).where("not a_strong and b_strong").select(F.col("a").alias("node"), F.col("b").alias("other"), "tier", "n")
    near = ways.join(persons.withColumnRenamed("node", "other"), "other").groupBy("node", "person").agg(F.max(F.struct("tier", -F.col("n"))).alias("fit"))
    equals = near.groupBy("node", "fit").agg(F.count("*").alias("k"), F.min("person").alias("person"))
    best = cut(equals.groupBy("node").agg(F.max_by(F.struct("k", "person"), "fit").alias("top")).select("node", "top.*"))
    joined = best.where("k = 1").select("node", "person")

    # What fits no person at all is linked among itself, to equals only.
    rest = cut(weak.join(best, "node", "left_anti"))
    left = initial_forms(rest.where("length(g) > 1"))
    alike = cut(judged(shared(left, left).where("a < b"), rest))
    among = with_date.union(by_name).union(alike).where("(dated and kg >= 1) or kg >= 2").join(named(rest, "a"), "a", "left_semi").join(named(rest, "b"), "b", "left_semi")
    others = components(among, rest.select("node"))
    alone = best.where("k > 1").select("node", F.col("node").alias("person"))
    ids = rows.join(nodes.select("node", *key), key).select("name_id", "node")
    return ids.join(persons.union(joined).union(others).union(alone), "node").select("name_id", "person")


def pairs(linked: DataFrame) -> DataFrame:
    """All pairs of rows of one person, smaller id first."""
    other = linked.select(F.col("name_id").alias("name_id_b"), "person")
    return linked.withColumnRenamed("name_id", "name_id_a").join(other, "person").where("name_id_a < name_id_b").select("name_id_a", "name_id_b")
