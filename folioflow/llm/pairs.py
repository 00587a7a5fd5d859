"""Broken prompt and response pairs: labelling functions and an EM label model.

For every defect several noisy labelling functions look at a prompt and an answer; each
votes 1 (defective), 0 (sound) or -1 (no opinion). Only the counts of vote patterns leave
the executors (at most 3 to the number of functions each). On these counts expectation
maximisation fits, per defect, how often it occurs and how each function, where it has an
opinion, votes on defective and sound answers; a pattern's posterior follows. An answer keeps every label
whose posterior passes that defect's cutoff; where one label is wanted, the highest posterior
is taken, and of those within ``NEAR`` of it the first in ``DEFECTS``.

Cutoffs are validated on answers with known defects: every answer that no function objects to
is spoilt by rule, once for each defect, and goes through the same functions and the fitted model; of the cutoffs that give the best F1 the middle
one is taken.

Three functions learn from the whole table: the language that an instruction's longer
answers are mostly in, the language that a short stock answer is mostly asked in, and the last
words that finished sentences of any answer end with.

Defined results: a null markdown is an empty answer, a null live answer is none; a null
prompt is an empty one; a prompt whose language can't be told gives no language label.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from folioflow.llm.language import Centroids, letters, normal
from folioflow.llm.sentences import GENERAL, REFERENCES, TITLES, sentence_spans
from folioflow.session import cut_lineage, partitions, salted_join

DEFECTS = ("empty", "echo", "refusal", "truncated", "language")
CUTOFF, NEAR, SPOILT = 0.5, 0.1, 1000  # cutoff where none can be validated, see above, answers read at a time
STOCK, LONG = 60, 50  # letters: up to these a stock answer, from these of a tellable language
# Stand-ins for nothing, closing verdicts, and languages as they are named.
NOTHING = {"", "null", "none", "nil", "n/a", "na", "undefined", "nan", "tbd", "todo", "empty", "no answer", "no response", "[]", "{}"}
VERDICTS = ("improves", "worsens", "mixed", "unclear", "good", "poor", "fair", "likely", "unlikely", "sound", "doubtful", "neutral", "possible", "none", "unchanged")
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés inglese inglês engels engelska angielski", "de": "german deutsch allemand alemán tedesco alemão duits tyska niemiecki", "fr": "french französisch français francés francese francês frans franska francuski",
    "es": "spanish spanisch espagnol español spagnolo espanhol spaans spanska hiszpański", "it": "italian italienisch italien italiano italiaans italienska włoski", "pt": "portuguese portugiesisch portugais portugués portoghese português portugees portugisiska portugalski",
    "nl": "dutch niederländisch néerlandais neerlandés holandés olandese neerlandês holandês nederlands nederländska niderlandzki", "sv": "swedish schwedisch suédois sueco svedese zweeds svenska szwedzki", "pl": "polish polnisch polonais polaco polacco polonês pools polska polski",
    "ru": "russian russisch russe ruso russo ryska rosyjski", "tr": "turkish türkisch turc turco turks turkiska turecki",
}
# Refusals as the functions know them, to validate with.
REFUSALS = ("I’m sorry, but I can’t help with that.", "I cannot assess this text.", "Diese Anfrage kann ich leider nicht bearbeiten.", "Je ne peux pas vous aider avec cela.", "Lo siento, no puedo ayudar con eso.", "Mi dispiace, non posso aiutare.", "Não posso ajudar com isso.", "Hier kan ik helaas niet mee helpen.")
_NAMED = {w: k for k, v in LANGUAGE_NAMES.items() for w in v.split()}
_REFUSES = re.compile(
    r"""\b(?:i(?:’|')?m sorry,? but i can|i can(?:no|’|')t (?:help|assist|do|give|provide|assess|judge|evaluate|answer|comment|review)|cannot (?:help|assist|give|provide|assess|judge|evaluate|comply|answer)|unable to (?:assess|help|judge|evaluate|answer|review|comment|assist)|not able to (?:help|assess|assist|judge|answer)|must (?:decline|refuse)|decline to|against my (?:guidelines|policy|policies|rules)|i am (?:not )?allowed|what i am allowed|as an? (?:ai|language) ?model|won(?:’|')t be able)"""
    r"""|\b(?:als (?:ki|sprachmodell|ki-modell)|kann ich (?:leider )?nicht|leider nicht (?:helfen|bearbeiten|beurteilen)|nicht (?:bearbeiten|beantworten|weiterhelfen)|muss (?:ich )?(?:das |dies )?ablehnen|darf ich (?:dazu|das|hier))"""
    r"""|(?:je ne (?:peux|puis) (?:pas|malheureusement)|il m[’']est impossible|en tant que modèle|je dois (?:refuser|décliner)|je ne suis pas (?:en mesure|autorisé))"""
    r"""|\b(?:no puedo (?:ayudar|evaluar|responder|dar|hacer)|no me es posible|como modelo de lengua|debo (?:rechazar|negarme)|no estoy (?:autorizad|en condiciones))"""
    r"""|\b(?:non posso (?:aiutar|valutare|rispondere|dare|fare)|non sono in grado|come modello|devo (?:rifiutare|declinare)|non mi è possibile)"""
    r"""|\b(?:não posso (?:ajudar|avaliar|responder|dar|fazer)|não me é possível|como modelo de|devo (?:recusar|declinar)|não estou autorizad)"""
    r"""|\b(?:kan ik (?:niet|helaas)|kan (?:dit|deze|het) (?:\w+ )?(?:helaas )?niet (?:beoordelen|beantwoorden)|niet mee helpen|als taalmodel|moet ik (?:weigeren|afwijzen)|mag ik (?:niet|geen))""",
    re.IGNORECASE,
)
_REGRET = re.compile(r"\b(?:sorry|unfortunately|apolog|leid|leider|désolé|regrette|malheureusement|lo siento|lamento|mi dispiace|purtroppo|spiace|desculp|infelizmente|spijt|helaas)\b", re.IGNORECASE)
_POINTER = re.compile(r"\b(?:please|bitte|veuillez|por favor|per favore|alstublieft|consult|wenden|consulte|raadpleeg|rivolg)", re.IGNORECASE)
_ZERO = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad\\s]+")
_FENCE = re.compile(r"```")
_TAIL = re.compile(r"(?:\[\^[^\]]*\]|[\s”“»)\]\"'’*_])+$")


def clean(answer: str) -> str:
    return re.sub("[\u200b-\u200f\u2060\ufeff\u00ad]", "", answer).strip()


def prose(answer: str) -> str:
    """The answer's own words: no fences, quotations, headings or verdict words."""
    out, fenced = [], False
    for line in answer.split("\n"):
        s = line.strip()
        if s.startswith("```"):
            fenced = not fenced
        elif not fenced and s and not s.startswith((">", "#", "[{")) and s.lower().strip("*. ") not in VERDICTS:
            out.append(re.sub(r"^(?:[-*+•]|\d+[.)])\s+", "", s))
    return "\n".join(out)


def words(text: str) -> list[str]:
    return re.findall(r"\w+", text.casefold())


def instruction(prompt: str) -> tuple[str, str | None]:
    """(the instruction without the naming of a language, the language it names)."""
    head = re.split(r"\n\s*\n", prompt.strip(), maxsplit=1)[0].strip()
    named = next((_NAMED[w] for w in words(head) if w in _NAMED), None)
    if named:
        spans = sentence_spans(head)
        kept = [head[a:b] for a, b in spans if not any(w in _NAMED for w in words(head[a:b]))]
        head = " ".join(kept) or head
    return head, named


def ending(text: str) -> str:
    return " ".join(normal(text).split()[-2:])


def _shingles(w: list[str], n: int = 4) -> list[tuple[str, ...]]:
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def votes_empty(raw: str, text: str) -> list[int]:
    n = letters(text)
    bare = text.strip("`*_-–—.…#>[](){}\"' \n").lower()
    return [1 if n == 0 else 0 if n >= 8 else -1, 1 if bare in NOTHING else 0, 1 if n < 3 else 0 if n >= 8 else -1, 1 if not _ZERO.sub("", raw) else -1]


def votes_echo(text: str, prompt: str) -> list[int]:
    a = words(text)
    if len(a) < 5:
        return [-1, -1, -1]
    p = words(prompt)
    body = words(re.split(r"\n\s*\n", prompt.strip(), maxsplit=1)[-1])
    known = set(_shingles(p))
    mine = _shingles(a)
    share = sum(s in known for s in mine) / len(mine)
    new = sum(1 for w in a if w not in set(p))
    return [1 if a in (p, body) else 0 if share < 0.5 else -1, 1 if share >= 0.8 else 0, 1 if new <= 0.05 * len(a) else 0 if new >= 6 else -1]


def sentences(own: str) -> list[list[str]]:
    """The sentences of an answer's own words, line by line."""
    return [[line[a:b] for a, b in sentence_spans(line)] for line in own.split("\n")]


def votes_refusal(text: str, own: str | None = None, parts: list[list[str]] | None = None) -> list[int]:
    own = prose(text) if own is None else own
    spans = [x for line in (sentences(own) if parts is None else parts) for x in line]
    if not spans:
        return [-1, -1, -1]
    hits = [bool(_REFUSES.search(s)) for s in spans]
    other = sum(1 for s, h in zip(spans, hits, strict=True) if not h and not _POINTER.search(s) and not _REGRET.search(s) and letters(s) > 12)
    return [int(any(hits)), 1 if any(hits) and other == 0 else 0, 1 if (_REGRET.search(spans[0]) or hits[0]) and len(own) < 220 and other == 0 else 0 if other >= 2 or len(own) > 400 else -1]


def endings(parts: list[list[str]]) -> list[str]:
    """The last two words of the sentences of an answer that are followed by another one."""
    return list(dict.fromkeys(ending(x) for line in parts for x in line[:-1]))


def last_words(text: str) -> str:
    lines = [x for x in text.split("\n") if x.strip()]
    return ending(_TAIL.sub("", lines[-1].strip())) if lines else ""


def votes_truncated(text: str, sibling: str | None, error: str, known: bool) -> list[int]:
    """``known``: whether the answer's last words end a finished sentence somewhere."""
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines or text.strip("`*_-–—.…#>[](){}\"' \n").lower() in NOTHING:
        return [-1] * 6
    last = lines[-1].strip()
    fences = len(_FENCE.findall(text))
    open_fence = fences % 2 == 1
    closed = fences and not open_fence and last.endswith("```")
    verdict = len(lines) > 1 and lines[-2].lstrip().startswith("#")
    heading = last.startswith("#")
    listed = bool(re.match(r"(?:[-*+•>]|\d+[.)])\s", last))
    tail = _TAIL.sub("", last)
    stop = tail[-1:] in ".!?…。！？।"
    t1 = 1 if open_fence else 0 if closed else -1
    structure = closed or verdict or heading or open_fence
    t2 = -1 if structure or listed else 0 if stop else 1
    abbreviated = stop and tail.endswith(".") and tail.rstrip(".").rsplit(" ", 1)[-1].lower().lstrip("(„“«") in (GENERAL | REFERENCES | TITLES) - {"al", "v", "s"} and not known
    t3 = -1 if structure else (1 if abbreviated else 0) if stop else (0 if known else 1)
    if verdict and not closed:
        w = last.lower().strip("*. ")
        t4 = 0 if w in VERDICTS else 1 if any(v.startswith(w) for v in VERDICTS) else -1
    else:
        t4 = 1 if heading else -1
    s = clean(sibling or "")
    t5 = -1
    if s and s != text:
        t5 = 1 if s.startswith(text) else 0 if text.startswith(s) else -1
    t6 = 1 if re.search(r"cut at the limit|truncat|length limit|max[_ ]tokens|abgeschnitten", error, re.IGNORECASE) else -1
    return [t1, t2, t3, t4, t5, t6]


FIELDS = "assess_id bigint, answer_field string, instr string, instr_lang string, named string, lang string, lang_conf double, stock string, tail string, ends array<string>, v_empty string, v_echo string, v_refusal string, v_truncated string, v_truncated_known string"
_NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def read_rows(rows: list[tuple], model: Centroids) -> list[list]:
    """``rows`` of (assess_id, prompt, markdown, error, live_answer) → ``FIELDS`` of each answer."""
    show = lambda vs: "".join("?01"[v + 1] for v in vs)

    def tell(texts: list[str]) -> list[tuple[str | None, float]]:
        if not texts:
            return []
        sims = model.similarities(texts)
        out = []
        for t, s in zip(texts, sims, strict=True):
            o = np.argsort(-s)
            out.append((model.languages[o[0]] if t and s[o[0]] > 0 else None, float(s[o[0]] - (s[o[1]] if len(o) > 1 else 0))))
        return out

    out, instr_texts, answer_texts = [], [], []
    for key, *parts in rows:
        prompt, markdown, error, live = (x if isinstance(x, str) else None for x in parts)
        prompt, error = prompt or "", error or ""
        both = {"markdown": markdown or "", "live_answer": live}
        head, named = instruction(prompt)
        for field, answer in both.items():
            if answer is None:
                continue
            text = clean(answer)
            said = prose(text)
            parts = sentences(said)
            own = normal(said)
            n = len(own) - own.count(" ")
            sibling = both["live_answer" if field == "markdown" else "markdown"]
            cut = show(votes_truncated(text, sibling, error, False))
            known = show(votes_truncated(text, sibling, error, True)) if cut[2] == "1" else cut
            out.append([key, field, head, None, named, None, 0.0, own if 0 < n <= STOCK and "\n" not in text else None, last_words(text), endings(parts), show(votes_empty(answer, text)), show(votes_echo(text, prompt)), show(votes_refusal(text, said, parts)), cut, known])
            instr_texts.append(normal(head))
            answer_texts.append(own)
    heads = {t: x for t, x in zip(dict.fromkeys(instr_texts), tell(list(dict.fromkeys(instr_texts))), strict=True)}
    for row, t, a, (lang, margin) in zip(out, instr_texts, answer_texts, tell(answer_texts), strict=True):
        row[3] = "es" if re.search("[¿¡]", row[2]) else heads[t][0]
        if len(a) - a.count(" ") >= LONG:
            row[5], row[6] = lang, margin
    return out


def read_answers(table: DataFrame, model: Centroids) -> DataFrame:
    """One row per answer: its votes that need nothing else, and what the others need."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(read_rows(list(b.itertuples(index=False, name=None)), model), columns=_NAMES)

    return table.select("assess_id", "prompt", "markdown", "error", "live_answer").mapInPandas(run, FIELDS)


def _majority(df: DataFrame, key: str, value: str, out: str, least: int = 4, share: float = 0.55) -> DataFrame:
    counts = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.max(F.struct("n", value)).alias("m"), F.sum("n").alias("all"))
    return best.where((F.col("m.n") >= least) & (F.col("m.n") >= share * F.col("all"))).select(key, F.col(f"m.{value}").alias(out))


def em_posteriors(patterns: Counter, rounds: int = 60) -> dict[str, float]:
    """Posterior of the defect for each vote pattern ('0', '1' or '?' a function)."""
    names = sorted(patterns)
    if not names:
        return {}
    v = np.array([["?01".index(c) for c in p] for p in names])
    n = np.array([patterns[p] for p in names], dtype=float)
    ones, zeros = (v == 2).sum(axis=1), (v == 1).sum(axis=1)
    post = np.where(ones + zeros > 0, np.clip(ones / np.maximum(1, ones + zeros), 0.02, 0.98), 0.02)
    for _ in range(rounds):
        a, b = n * post, n * (1 - post)
        prior = (a.sum() + 1) / (n.sum() + 20)
        like = np.log(prior) - np.log(1 - prior)
        odds = np.full(len(names), like)
        for f in range(v.shape[1]):
            said = v[:, f] > 0  # no opinion says nothing
            one = v[:, f] == 2
            p1 = (a[one].sum() + 4) / (a[said].sum() + 5)  # functions are taken to be right more often than not
            p0 = (b[one].sum() + 1) / (b[said].sum() + 20)
            odds += np.where(one, np.log(p1 / p0), np.where(said, np.log((1 - p1) / (1 - p0)), 0.0))
        post = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        post = np.where(ones == 0, 0.0, post)  # no function says so
    return dict(zip(names, post.tolist(), strict=True))


def spoil(rows: list[dict], start: int = 0) -> list[tuple[str | None, tuple]]:
    """(defect or None, (assess_id, prompt, answer, error, live)) made of sound answers, each as it is and spoilt in every way."""
    out: list[tuple[str | None, tuple]] = []
    other: list[str | None] = [None] * len(rows)  # the next answer in another language, after the last one the first
    for n in range(2 * len(rows) - 1, -1, -1):
        k, x = n % len(rows), rows[(n + 1) % len(rows)]
        other[k] = x["answer"] if x["lang"] and x["lang"] != rows[k]["lang"] else other[(n + 1) % len(rows)] if x["lang"] == rows[k]["lang"] else None
    for n, r in enumerate(rows):
        prompt, answer = r["prompt"], r["answer"]
        rng = random.Random(r["assess_id"])
        body = re.split(r"\n\s*\n", prompt.strip(), maxsplit=1)[-1]
        words_ = answer.split(" ")
        made = {
            None: answer, "empty": rng.choice(["", "  ", "null", "-", "N/A", "..."]), "echo": rng.choice([prompt, body]), "truncated": " ".join(words_[: rng.randint(max(1, len(words_) // 3), max(1, len(words_) - 2))]),
            "refusal": rng.choice(REFUSALS), "language": other[n],
        }
        out += [(d, (start + len(out) + k, prompt, a, "", None)) for k, (d, a) in enumerate(made.items()) if a is not None]
    return out


def validated_cutoffs(known: list[tuple[str | None, dict[str, float]]], counts: list[int] | None = None) -> dict[str, float]:
    """Per defect the middle of the cutoffs with the best F1 on (defect or None, posteriors), each as often as ``counts`` says."""
    n = np.ones(len(known)) if counts is None else np.array(counts, dtype=float)
    out = {}
    grid = np.round(np.arange(0.05, 0.96, 0.05), 2)
    for d in DEFECTS:
        p = np.array([post.get(d, 0.0) for _, post in known])
        y = np.array([k == d for k, _ in known], dtype=bool)
        if not y.any() or y.all():
            out[d] = CUTOFF
            continue
        f1 = [2 * n[y & (p >= c)].sum() / max(1, n[y].sum() + n[p >= c].sum()) for c in grid]
        best = grid[np.flatnonzero(np.isclose(f1, max(f1)))]
        out[d] = float(best[len(best) // 2])
    return out


def label_pairs(table: DataFrame, model: Centroids) -> tuple[DataFrame, dict[str, float]]:
    """``(assess_id, answer_field, posteriors map<string,double>)`` of every answer, and the validated cutoffs."""
    read = cut_lineage(read_answers(table, model).dropDuplicates(["assess_id", "answer_field"]))
    read = read.withColumn("rid", F.xxhash64("assess_id", "answer_field"))
    ends = cut_lineage(read.select(F.explode("ends").alias("tail")).where("tail <> ''").distinct())
    read = salted_join(read.drop("ends"), ends.withColumn("known", F.lit(True)), "tail", "rid")
    read = read.withColumn("v_truncated", F.when(F.col("known"), F.col("v_truncated_known")).otherwise(F.col("v_truncated")))
    by_instr = _majority(read.where("named is null and lang_conf >= 0.03"), "instr", "lang", "instr_major")
    asked = salted_join(read, by_instr, "instr", "rid").withColumn("expected", F.coalesce("named", "instr_major", "instr_lang"))
    by_stock = _majority(asked, "stock", "expected", "stock_lang")
    asked = salted_join(asked, by_stock, "stock", "rid")
    vote = lambda c, ok: F.when(c.isNull() | F.col("expected").isNull() | ~ok, "?").when(c == F.col("expected"), "0").otherwise("1")
    always = F.lit(True)
    v_lang = F.concat(vote(F.col("lang"), always), vote(F.col("lang"), F.col("lang_conf") >= 0.05), vote(F.col("stock_lang"), always))
    voted = cut_lineage(asked.withColumn("v_language", v_lang).select("assess_id", "answer_field", "rid", "lang", "expected", *[f"v_{d}" for d in DEFECTS]))
    counts = voted.select(F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"v_{d}").alias("p")) for d in DEFECTS])).alias("x")).groupBy("x.d", "x.p").agg(F.count("*").alias("n"))
    patterns: dict[str, Counter] = {d: Counter() for d in DEFECTS}
    for r in counts.collect():  # at most 3 to the number of a defect's functions rows each
        patterns[r["d"]][r["p"]] = r["n"]
    posts = {d: em_posteriors(patterns[d]) for d in DEFECTS}
    out = voted
    for d in DEFECTS:
        pairs = [(p, x) for p, x in posts[d].items() if x > 0]
        look = F.create_map(*[F.lit(z) for p in pairs for z in p]) if pairs else F.expr("cast(map() as map<string,double>)")
        out = out.withColumn(f"p_{d}", F.coalesce(F.try_element_at(look, F.col(f"v_{d}")), F.lit(0.0)))
    labelled = out.select("assess_id", "answer_field", F.create_map(*[z for d in DEFECTS for z in (F.lit(d), F.col(f"p_{d}"))]).alias("posteriors"))
    return labelled, _validate(table, voted, ends, posts, model)


def _validate(table: DataFrame, voted: DataFrame, ends: DataFrame, posts: dict[str, dict[str, float]], model: Centroids) -> dict[str, float]:
    """Cutoffs from spoilt answers, see above; what is collected are counts of vote patterns."""
    sound = voted.where("answer_field = 'markdown' and lang = expected")
    for d in DEFECTS:
        sound = sound.where(~F.col(f"v_{d}").contains("1"))
    texts = table.select("assess_id", "prompt", F.col("markdown").alias("answer")).where("prompt is not null and length(answer) >= 60").dropDuplicates(["assess_id"])
    rows = texts.join(sound.select("assess_id", "lang"), "assess_id")
    # the bytes are few for the work, and neighbours, from which answers of another language are taken, are the same every time
    rows = rows.repartition(partitions(table.sparkSession), F.xxhash64("assess_id", F.lit("spoilt"))).sortWithinPartitions("assess_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = [x for k in range(0, len(b), SPOILT) for x in spoil(b.iloc[k : k + SPOILT].to_dict("records"), 6 * k)]
            defect = {x[0]: d for d, x in known}
            out = []
            for g in (g for k in range(0, len(known), SPOILT) for g in read_rows([x for _, x in known[k : k + SPOILT]], model)):
                f = dict(zip(_NAMES, g, strict=True))
                expected = f["named"] or f["instr_lang"]
                said = "?" if not f["lang"] or not expected else "0" if f["lang"] == expected else "1"
                out.append((defect[f["assess_id"]], f["tail"], f["v_empty"], f["v_echo"], f["v_refusal"], f["v_truncated"], f["v_truncated_known"], said + (said if f["lang_conf"] >= 0.05 else "?") + "?"))
            yield pd.DataFrame(out, columns=["defect", "tail", "v_empty", "v_echo", "v_refusal", "v_truncated", "v_truncated_known", "v_language"])

    spoilt = rows.mapInPandas(run, "defect string, tail string, v_empty string, v_echo string, v_refusal string, v_truncated string, v_truncated_known string, v_language string")
    # counted before the endings are looked up, so that these are few
    votes = ["defect", "v_empty", "v_echo", "v_refusal", "v_truncated", "v_language"]
    counted = spoilt.groupBy(*votes, "v_truncated_known", "tail").agg(F.count("*").alias("n"))
    counted = salted_join(counted.withColumn("rid", F.xxhash64(*votes, "tail")), ends.withColumn("known", F.lit(True)), "tail", "rid")
    counted = counted.withColumn("v_truncated", F.when(F.col("known"), F.col("v_truncated_known")).otherwise(F.col("v_truncated"))).groupBy(*votes).agg(F.sum("n").alias("n"))
    got = counted.collect()
    return validated_cutoffs([(r["defect"], {d: posts[d].get(r[f"v_{d}"], 0.0) for d in DEFECTS}) for r in got], [r["n"] for r in got])


def defects(labelled: DataFrame, cutoffs: dict[str, float]) -> DataFrame:
    """Every label over its cutoff: ``(assess_id, answer_field, defect, posterior, rank)``; rank 1 is the one to keep."""
    e = labelled.select("assess_id", "answer_field", F.explode("posteriors").alias("defect", "posterior"))
    over = F.lit(False)
    for d in DEFECTS:
        over = over | ((F.col("defect") == d) & (F.col("posterior") >= cutoffs[d]))
    of = W.partitionBy("assess_id", "answer_field")  # at most five rows
    kept = e.where(over).withColumn("_near", F.col("posterior") >= F.max("posterior").over(of) - NEAR)
    order = F.array_position(F.array(*map(F.lit, DEFECTS)), F.col("defect"))
    return kept.withColumn("rank", F.row_number().over(of.orderBy(F.desc("_near"), F.when(F.col("_near"), order), F.desc("posterior"), order))).drop("_near")
