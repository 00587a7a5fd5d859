"""Variant spellings of persons' and bodies' names: suffix blocking and LCS comparison.

A spelling is read into fields: a body's kind, place and topic, or a person's surname,
first given name and middle initial. Suffixes of the surname or place above a minimum length
index it. A suffix that too many spellings share is refined with fields of the given name
(its possible initials, its ending); what stays too common is refined with the head of the
surname. Spellings under a key that is common even then meet by their surname less one letter
(less two from thirteen letters on) together with the given name, its forms less one letter,
its cut form or, where only an initial is written, that initial. Candidate pairs link when
their surnames' longest-common-subsequence ratio is high enough and the given names agree.

Given names agree when they are equal, one is the initial or a cut form of the other, or one
is a slip of the other by the same ratio; a short list of pet names only adds agreements. Two
given names that are both usual among the spellings (each with several surnames) are two
names, however alike. Equal given names make persons first; a spelling that says less (an
initial, a pet form of several names, a slip) joins the one person it fits, and none where
it fits several. Links then close to groups.

Defined results: null, blank and generic authors (roles, robots) are in no group; repeated
spellings count once; equal names in other cases, blanks or accents are variants.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folioflow.session import cut_lineage, salted_join

LEAST_SUFFIX, HEAD, COMMON, RATIO = 4, 3, 60, 0.845
# Roles that are no names.
GENERIC = {"author", "reviewer", "unknown", "user", "editor", "guest", "admin", "administrator", "anonymous", "anonym", "owner", "default", "system", "none", "null", "n/a", "na", "translator", "revision robot", "microsoft office user", "office user", "benutzer", "unbekannt", "auteur", "autor", "autore", "robot", "bot", "root", "test", "me"}
TITLES = {"dr", "prof", "mr", "mrs", "ms", "sir", "dame", "ing", "mag", "dipl", "phd", "msc", "rev", "hon"}
PARTICLES = {"de", "van", "von", "der", "den", "del", "di", "da", "la", "le", "ter", "zu", "dos", "du"}
KINDS = {"press": "press", "pr": "press", "publishers": "press", "publishing": "press", "verlag": "press", "university": "univ", "univ": "univ", "universitat": "univ", "universidad": "univ", "institute": "inst", "inst": "inst", "institut": "inst", "society": "soc", "soc": "soc", "council": "council", "academy": "academy", "acad": "academy", "library": "library", "ministry": "ministry", "museum": "museum", "college": "college", "foundation": "foundation", "archive": "archive", "archives": "archive"}
COMPANY = {"ltd", "limited", "inc", "gmbh", "plc", "llc", "co", "ag", "sa", "editorial", "office", "dept", "department"}
SMALL = {"for", "f", "of", "the", "and", "fur", "de", "la"}
# Pet forms that no rule gives; they add evidence and decide nothing alone.
GIVEN = """matthias: hias matt mat matze; aleksandra: ola sasha alex ale sandra aleks; giovanni: gianni gio nino vanni gian; gabriela: gabi ela gaby gabe; susanna: sue susi suse sanna suzy susie; dorothea: doro dot dorothy dora dolly thea; josefina: josie pepa fina jo josy; wilhelmina: billie wil mina minna willa helma;
katharina: katja kit kat kathi kate kati katrin; monica: moni mona nica; nikolaus: klaus nik niko nick nicky claus; alexander: alex xander sasha sandy ale al; antonio: toni tono tonio nino tony; johannes: hannes hans joh johann jo; zoe: zo zoey; andre: dre andy andi; gunther: gunni gun gunter; francisco: paco pancho fran cisco kiko frank;
margarethe: greta marga grete maggie peggy gretel; frederik: fred freddy rik fritz fredi; michael: mike mick mic micha mickey; lucja: luca lucy lucka lucia luc; isabella: bella isa izzy ella bel; benjamin: ben benny benni benji; elizabeth: betty liz beth ellie lisa eliza lizzie ela elsa betsy; lawrence: larry laurie law lars loz; sebastian: seb basti bastian bas; roberta: robbie bobbie bob berta robin rob;
jorg: jogi jory; renee: ren renie nee; christopher: chris kit topher kris; soren: so sorn; magdalena: lena mag magda maddie leni maggie; theodora: teddy dora thea theo teodora dorothy; eleonora: nora ele ellie lora leonora nelly lea; guillaume: gui guy will guil willy; petra: pet; robert: rob bob bobby; william: will bill billy; richard: dick rick; edward: ed ted ned; margaret: peggy meg maggie"""
FORMAL: dict[str, set[str]] = {}
for _part in re.split(r"[;\n]", GIVEN):
    _name, _, _short = _part.strip().partition(":")
    if not _name:
        continue
    FORMAL.setdefault(_name, set()).add(_name)
    for _s in _short.split():
        FORMAL.setdefault(_s, set()).add(_name)


def fold(text: str) -> str:
    """Lower case without accents; written-out umlauts and their vowels fall together."""
    t = text.casefold().replace("ł", "l").replace("ø", "o").replace("đ", "d").replace("ı", "i").replace("æ", "ae").replace("œ", "oe")
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return re.sub(r"(?<=[aou])e", "", t)


FORMAL = {k: v | ({k} if any(k in w for w in FORMAL.values()) else set()) for k, v in FORMAL.items()}
FORMAL = {fold(k): {fold(x) for x in v} for k, v in FORMAL.items()}
#: A given name is usual with so many surnames, unless another form of it has ten times as many.
USUAL, RARER = 3, 10


def lcs_ratio(a: str, b: str) -> float:
    """2 * LCS / (len a + len b), by bit-parallel rows; two empty strings are equal."""
    if not a or not b:
        return float(a == b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return 2 * (len(a) - v.bit_count()) / (len(a) + len(b))


def _subsequence(short: str, whole: str) -> bool:
    it = iter(whole)
    return all(c in it for c in short)


def initials(first: str) -> set[str]:
    return {x[0] for x in FORMAL.get(first.rstrip("."), ()) or (first,) if x} | {first[:1]}


def same_given(x: str, y: str, n_x: int = 0, n_y: int = 0) -> bool:
    """Whether two folded given names can be one person's; ``n_x`` and ``n_y`` are how many surnames each
    has, and a full stop at the end marks a cut form."""
    if not x or not y:
        return False
    if x == y:
        return True
    if len(x) == 1 or len(y) == 1:
        return x in initials(y) if len(x) == 1 and len(y) > 1 else y in initials(x) if len(x) > 1 else False
    cut, (x, y) = x.endswith(".") or y.endswith("."), (x.rstrip("."), y.rstrip("."))
    if (FORMAL.get(x, set()) | {x}) & (FORMAL.get(y, set()) | {y}):
        return True
    if not cut and min(n_x, n_y) >= USUAL and min(n_x, n_y) * RARER > max(n_x, n_y):
        return False  # two names in their own right
    short, whole = sorted((x, y), key=len)
    if whole.startswith(short) or (len(short) >= 3 and (whole.endswith(short) or (short[0] == whole[0] and _subsequence(short, whole)))):
        return True
    ends = x[0] == y[0] and x[-1] == y[-1]  # letters that changed places
    return len(short) >= 4 and (lcs_ratio(x, y) >= (0.75 if ends else 0.8) or (ends and sorted(x) == sorted(y)))


def parse(author: str | None) -> dict | None:
    """Fields of a spelling: ``kind`` ('person', 'login' or a body's), ``core`` (surname, place
    or login), ``first`` (given name or initial), ``middle``, ``topic`` and ``turned`` (whether the
    parts may stand the other way round); None for no name."""
    if not isinstance(author, str):
        return None
    t = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", author)).strip()
    t = re.sub(r"\s*\([^)]*\)\s*$", "", t)
    low = t.casefold().strip(" .")
    if not low or low in GENERIC or not any(map(str.isalpha, low)):
        return None
    words = [w for w in re.split(r"[\s,]+", t) if w]
    folded = [fold(w).strip(".") for w in words]
    kinds = [KINDS[w] for w in folded if w in KINDS]
    if kinds or any(w in COMPANY for w in folded):
        rest = [w for w in folded if w not in KINDS and w not in COMPANY and w not in SMALL]
        if not rest:
            return None
        if folded[0] in KINDS and len(rest) > 1:  # "Institute for Topic, Place"
            rest = [rest[-1], *rest[:-1]]
        return {"kind": kinds[0] if kinds else "company", "core": rest[0].replace("-", ""), "first": "", "middle": "", "topic": " ".join(rest[1:]), "turned": False}
    while len(words) > 1 and folded[0] in TITLES and not (folded[0] == "mag" and len(words) == 2):
        words, folded = words[1:], folded[1:]
    person = {"kind": "person", "topic": "", "turned": False}
    turned = False
    glue = lambda ws: re.sub(r"[^a-z0-9]", "", "".join(ws)) or "".join(ws)
    if "," in t:
        left, _, right = t.partition(",")
        sur = [fold(w).strip(".") for w in left.split() if fold(w).strip(".") not in TITLES]
        giv = [fold(w).strip(".") for w in right.split() if fold(w).strip(".") not in TITLES]
    elif "." in words[0].strip(".") and len(words[0].strip(".").split(".")[0]) > 1 and words[0] == words[0].lower():
        head, _, tail = folded[0].partition(".")
        giv, sur = [head], [tail, *folded[1:]]
    elif len(words) == 1 or (words[0].islower() and re.fullmatch(rf"[a-z]{{1,2}}({'|'.join(sorted(PARTICLES))})", folded[0]) and folded[0] not in FORMAL):
        core = glue(folded)
        return person | {"kind": "login", "core": core, "first": core[:1], "middle": ""}
    else:
        upper = [w.isupper() and len(w.strip(".")) > 1 for w in words]
        last = folded[-1]
        if upper[0] and not upper[-1] and not all(upper):
            k = next(i for i, u in enumerate(upper) if not u)
            sur, giv = folded[:k], folded[k:]
        elif last in FORMAL and folded[0] not in FORMAL and len(folded[0]) > 1 and not words[0].endswith("."):
            sur, giv = folded[:-1], folded[-1:]
        else:
            k = 1
            while k < len(words) - 1 and len(folded[k]) == 1:
                k += 1
            giv, sur = folded[:k], folded[k:]
            turned = len(words) == 2 and min(map(len, folded)) > 1
    giv = [g for g in giv if g]
    core = glue(sur)
    if not core:
        return None
    dotted = {fold(w).strip(".") for w in re.split(r"[\s,]+", t) if w.endswith(".")}
    first = giv[0] + "." * (len(giv[0]) > 1 and giv[0] in dotted) if giv else ""
    return person | {"core": core, "first": first, "middle": next((g[0] for g in giv[1:] if len(g) == 1), ""), "turned": turned}


def readings(author: str | None) -> list[dict]:
    """How a spelling can be read: ``parse``, and ``U.`` before one word as a university's too."""
    p = parse(author)
    if p and p["kind"] == "person" and p["first"] == "u" and re.fullmatch(r"\s*[Uu]\.\s+\S+\s*", author):
        return [p, p | {"kind": "univ", "first": "", "turned": False}]
    return [p] if p else []


def same_name(a: dict, b: dict) -> float:
    """Ratio of the cores where two spellings can be one name, else 0."""
    if a["kind"] == "login" and b["kind"] == "login":
        return float(a["core"] == b["core"])
    if "login" in (a["kind"], b["kind"]):
        login, other = (a, b) if a["kind"] == "login" else (b, a)
        if other["kind"] != "person":
            return 0.0
        text, initial = login["core"], other["first"][:1]
        best = 0.0
        for k in (1, 2):
            head, tail = text[:k], text[k:]
            if initial and head[:1] == initial and (k == 1 or not other["middle"] or head[1:] == other["middle"]):
                best = max(best, lcs_ratio(tail, other["core"]) if tail != other["core"] else 1.0)
        return best if best >= 0.93 else 0.0
    if a["kind"] != b["kind"]:
        return 0.0
    ratio = lcs_ratio(a["core"], b["core"])
    if ratio < RATIO:
        return 0.0
    if a["kind"] != "person":
        return ratio if lcs_ratio(a["topic"], b["topic"]) >= 0.85 else 0.0
    if a["middle"] and b["middle"] and a["middle"] != b["middle"]:
        return 0.0
    return ratio if same_given(a["first"], b["first"], a.get("n_first") or 0, b.get("n_first") or 0) else 0.0


def certainty(p: dict) -> tuple[int, int]:
    """How much a reading says of the given name: nothing or an initial, a cut form or a pet form of several names, a name; then how usual that is."""
    first = p["first"]
    if p["kind"] != "person":
        return (0, 0) if p["kind"] == "login" else (2, 0)
    return (0 if len(first) < 2 else 1 if first.endswith(".") or len(FORMAL.get(first, ())) > 1 else 2, p.get("n_first") or 0)


def bond(a: dict, b: dict) -> int:
    """Of a link: 0 where it joins equals, 1 where ``a`` says less and joins ``b``, 2 the other way, 3 where both say
    too little; 4 where ``a`` is a rare form of the name of ``b``, 5 the other way."""
    (ca, na), (cb, nb) = certainty(a), certainty(b)
    if ca == cb == 2:
        one, two = (FORMAL.get(p["first"]) or {p["first"]} for p in (a, b))
        return 0 if one == two or (na < USUAL and nb < USUAL) else 4 if (na, a["first"]) < (nb, b["first"]) else 5
    return 1 if cb == 2 else 2 if ca == 2 else 3


def _suffixes(p: dict) -> list[str]:
    core = p["core"]
    return [core[i:] for i in range(max(1, len(core) - LEAST_SUFFIX + 1))] if len(core) > LEAST_SUFFIX else [core]


def _fields(p: dict) -> list[str]:
    """What two spellings of one name have in common besides the core: a possible initial, or the given name's ending."""
    if p["kind"] not in ("person", "login"):
        return [p["topic"][:3]]
    first = p["first"]
    return sorted({f"i{c}" for c in initials(first)}) + ([f"e{first[-3:]}"] if len(first) > 2 and first[-1] != "." else [])


def _less(text: str, most: int) -> set[str]:
    """The text less up to ``most`` letters."""
    out = {text}
    for _ in range(most):
        out |= {c[:i] + c[i + 1 :] for c in out for i in range(len(c))}
    return out


def _close_keys(p: dict) -> list[tuple[str, bool]]:
    """(key, whether only those that say an initial meet by it) for spellings under keys too common to refine."""
    core, first = p["core"], p["first"]
    if p["kind"] == "login":
        cores, given = {v for k in (0, 1, 2) for v in _less(core[k:], 1)}, [(f"i{core[:1]}", True)]
    else:
        cores = _less(core, 2 if len(core) >= 13 else 1)
        if p["kind"] != "person":
            given = [(p["topic"][:3], False)]
        else:
            given = [(f"i{c}", True) for c in sorted(initials(first))]
            if first.endswith("."):
                given.append((f"^{first[:2]}", False))
            elif len(first) > 1:
                names = {f"={x}" for x in FORMAL.get(first, {first})} | {f"-{x}" for x in _less(first, 1)} | {f"^{first[:2]}", f"e{first[-3:]}"}
                given += [(x, False) for x in sorted(names)]
    side = "person" if p["kind"] == "login" else p["kind"]
    return [(f"{side}!{g}!{v}", asks) for g, asks in given for v in sorted(cores)]


FIELDS = "kind string, core string, first string, middle string, topic string, n_first bigint"


def _pairs(keys: DataFrame, size: int = 1000) -> DataFrame:
    """Pairs of nodes under one key of ``keys(key, node, says)``; a key with many nodes is spread over tasks.
    Where ``says`` is null any two meet, else two of which one says no more than an initial (false)."""
    n = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("salts", F.ceil(F.col("n") / size).cast("int"))
    k = keys.join(n, "key")
    x = k.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    y = k.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    met = x.alias("x").join(y.alias("y"), ["key", "salt"]).where("x.node < y.node and (x.says is null or not x.says or not y.says)")
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _usual_order(read: DataFrame) -> DataFrame:
    """``read`` with ``n_first``, the number of surnames of its given name, and two-word names turned
    round whose last word is the given name by far more surnames than the first."""
    usual = read.where((F.col("kind") == "person") & (F.length("first") > 1)).groupBy("first").agg(F.countDistinct("core").alias("n_first"))
    usual = cut_lineage(usual)
    d = salted_join(read.withColumn("_r", F.xxhash64("spelling")), usual, "first", "_r")
    d = salted_join(d, usual.select(F.col("first").alias("core"), F.col("n_first").alias("n_core")), "core", "_r")
    listed = F.array(*[F.lit(x) for x in sorted(FORMAL)])
    by_list = F.array_contains(listed, F.col("core")) & ~F.array_contains(listed, F.col("first"))
    by_use = (F.coalesce("n_core", F.lit(0)) >= USUAL) & (F.col("n_core") > 3 * F.coalesce("n_first", F.lit(0)))
    turn = F.col("turned") & (by_list | by_use)
    swap = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    return d.select("spelling", "other", "kind", swap("core", "first").alias("core"), swap("first", "core").alias("first"), "middle", "topic", F.coalesce(swap("n_first", "n_core"), F.lit(0)).cast("bigint").alias("n_first"))


def _joining(links: DataFrame, persons: DataFrame, bond: int, skip: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the links of one kind: those of nodes that fit one person, ``(bad)`` nodes that fit several, and
    ``(v, fit)``. A surname that is exactly the same goes before one that is only close; ``skip(bad)`` are no persons."""
    d = links.where(F.col("bond") == bond).select(F.col("a").alias("v"), F.col("b").alias("u"), "ratio").union(links.where(F.col("bond") == bond + 1).select("b", "a", "ratio"))
    if skip is not None:
        d = d.join(skip, F.col("u") == F.col("bad"), "left_anti")
    d = cut_lineage(d.join(persons.withColumnRenamed("node", "u"), "u", "left").select("v", "u", "ratio", F.coalesce("group", "u").alias("person")))
    fits = d.groupBy("v").agg(F.max("ratio").alias("top"), F.collect_set(F.struct("ratio", "person")).alias("seen"))
    fits = cut_lineage(fits.select("v", F.array_distinct(F.transform(F.filter("seen", lambda s: (s["ratio"] == 1.0) | (F.col("top") < 1.0)), lambda s: s["person"])).alias("fits")))
    only = fits.where(F.size("fits") == 1).select("v", F.col("fits")[0].alias("fit"))
    return d.join(only, "v").where("person = fit").select(F.col("v").alias("a"), F.col("u").alias("b")), fits.where(F.size("fits") > 1).select(F.col("v").alias("bad")), only


def link_names(authors: DataFrame, column: str = "author", common: int = COMMON) -> DataFrame:
    """``(spelling, group)`` of every spelling that shares its name with another spelling;
    ``group`` is one number a name."""
    spellings = authors.select(F.col(column).alias("spelling")).where(F.length(F.trim("spelling")) > 0).distinct()
    names = [x.split()[0] for x in FIELDS.split(", ")]
    raw = ["kind", "core", "first", "middle", "topic", "turned"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, k > 0, *(p[n] for n in raw)) for s in b["spelling"] for k, p in enumerate(readings(s))]
            yield pd.DataFrame(rows, columns=["spelling", "other", *raw])

    parsed = cut_lineage(spellings.mapInPandas(read, "spelling string, other boolean, kind string, core string, first string, middle string, topic string, turned boolean"))
    parsed = cut_lineage(_usual_order(parsed).withColumn("node", F.xxhash64(*names[:-1])))
    nodes = parsed.groupBy("node").agg(*[F.first(n).alias(n) for n in names])

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b.to_dict("records"):
                side = "person" if p["kind"] in ("person", "login") else p["kind"]
                head, fields = p["core"][:2], _fields(p)
                rows += [(p["node"], f"{side}|{s}", fields, head) for s in _suffixes(p)]
                if p["kind"] != "login":
                    rows.append((p["node"], f"{side}^{p['core'][:HEAD]}", fields, head))
            yield pd.DataFrame(rows, columns=["node", "key", "fields", "head"])

    def counted(k: DataFrame) -> DataFrame:
        return k.join(k.groupBy("key").agg(F.count("*").alias("n")), "key")

    keys = cut_lineage(nodes.mapInPandas(index, "node bigint, key string, fields array<string>, head string").distinct())
    # an overly common suffix is refined by fields of the given name; where that is too common too, by the head as well
    keys = counted(keys)
    fine = cut_lineage(counted(keys.where(F.col("n") > common).select(F.explode("fields").alias("field"), "key", "node", "head").select(F.concat_ws("~", "key", "field").alias("key"), "node", "head")))
    wide = fine.where(F.col("n") > 4 * common)
    heads = counted(wide.select(F.concat_ws("~", "key", "head").alias("key"), "node"))
    kept = [keys.where(F.col("n") <= common), fine.where(F.col("n") <= 4 * common), heads.where(F.col("n") <= 4 * common)]
    says = F.lit(None).cast("boolean").alias("says")
    keys = reduce(DataFrame.union, [k.where("n > 1").select("key", "node", says) for k in kept])
    crowded = nodes.join(wide.select("node").distinct(), "node", "left_semi")

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, p["node"], certainty(p)[0] > 0 if asks else None) for p in b.to_dict("records") for k, asks in _close_keys(p)]
            yield pd.DataFrame(rows, columns=["key", "node", "says"])

    pairs = _pairs(keys.union(crowded.mapInPandas(close, "key string, node bigint, says boolean")))

    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.struct(*names).alias(f"p{name}"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x, y, p, q in zip(b["a"], b["b"], b["pa"], b["pb"], strict=True):
                p, q = dict(p), dict(q)
                r = same_name(p, q)
                if r > 0:
                    rows.append((x, y, r, bond(p, q)))
            yield pd.DataFrame(rows, columns=["a", "b", "ratio", "bond"])

    links = cut_lineage(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(compare, "a bigint, b bigint, ratio double, bond int"))
    equals = links.where("bond = 0").select("a", "b")
    # rare forms of a name join the one person they fit first, then what says less than a name
    slips, unsure_slips, _ = _joining(links, components(equals), 4)
    persons = components(equals.union(slips))
    less, unsure, only = _joining(links, persons, 1, unsure_slips)
    peers = links.where("bond = 3").select("a", "b").join(unsure, F.col("a") == F.col("bad"), "left_anti").join(unsure, F.col("b") == F.col("bad"), "left_anti")
    peers = peers.join(only.select(F.col("v").alias("a"), F.col("fit").alias("fa")), "a", "left").join(only.select(F.col("v").alias("b"), F.col("fit").alias("fb")), "b", "left")
    peers = peers.where("fa is null or fb is null or fa = fb").select("a", "b")
    group = components(equals.union(slips).union(less).union(peers))
    out = parsed.select("spelling", "other", "node").join(group, "node", "left").select("spelling", "other", F.coalesce("group", "node").alias("group"))
    # a second reading holds only among spellings that can't be read otherwise
    sure = out.where("not other").select("group").distinct()
    second = out.where("other").join(sure, "group", "left_semi").select("spelling", "group")
    out = out.where("not other").select("spelling", "group").join(second.select("spelling"), "spelling", "left_anti").union(second)
    out = cut_lineage(out)
    sizes = out.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    return out.join(sizes, "group").select("spelling", "group")


def components(edges: DataFrame) -> DataFrame:
    """``(node, group)``: smallest node of each connected component, by passing smaller
    labels along the edges and jumping to the label's own label, until nothing changes."""
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).select(F.col("a").alias("node"), F.col("l").alias("group")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("group").alias("m"))
        new = labels.join(near, "node").select("node", F.least("group", "m").alias("group"), F.col("group").alias("old"))
        jump = labels.select(F.col("node").alias("j"), F.col("group").alias("far"))
        new = cut_lineage(new.join(jump, F.col("group") == F.col("j"), "left").select("node", F.least("group", F.coalesce("far", "group")).alias("group"), "old"))
        changed = new.where("group <> old").limit(1).count()
        labels = new.select("node", "group")
        if not changed:
            return labels
