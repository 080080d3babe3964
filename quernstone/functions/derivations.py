"""Derivations: answers put together from spans of sources by closed rules, and rendered with their evidence.

A derivation is JSON with sources, steps, sentences and checks.  It is read into records; every span is
a run of tokens of a source; rules are rows of tables, and all that do not hold are reported together.
Findings of form may be waived by a sentence that states a deviation, findings of substance never.
"""

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

# Fixed values of the format: forms that agree with one another, words an antecedent may stand for, and the states of a step.
AGREEING = (("is", "are"), ("was", "were"), ("has", "have"), ("does", "do"), ("this", "these"), ("that", "those"), ("a", "an"))
PRONOUNS = tuple("he she it they him her them this these that those its their his hers theirs".split())
STATES = ("part", "stated", "gap", "ai")
GOAL = "Z"

_TOKEN = re.compile(r"(?P<marker>⟦[^⟧]*⟧|\[GAP[^\]]*\]|\[AI[^\]]*\])|(?P<word>\w+)|(?P<sign>[^\w\s])")
_QUOTES = {"‘": "'", "’": "'", "“": '"', "”": '"'}


@dataclass(frozen=True)
class Span:
    """A run of tokens, from the first to before the last, and its characters."""

    first: int
    last: int
    start: int
    end: int

    def meets(self, other: "Span") -> bool:
        return self.start < other.end and other.start < self.end


class Passage:
    """A text with single spaces, cut into words, signs and markers."""

    def __init__(self, text: object):
        self.text = " ".join(str(text or "").split())
        self.tokens = [(m.lastgroup, m.start(), m.end()) for m in _TOKEN.finditer(self.text)]
        self.forms = [self.text[a:b] for _, a, b in self.tokens]

    def words(self) -> list[str]:
        return [f for f, (kind, _, _) in zip(self.forms, self.tokens, strict=True) if kind == "word"]

    def spans(self, phrase: str, within: Span | None = None) -> Iterator[Span]:
        """Every run of whole tokens that reads as the phrase does."""
        wanted = Passage(phrase)
        n = len(wanted.forms)
        low, high = (within.first, within.last) if within else (0, len(self.forms))
        for i in range(low, high - n + 1) if n else ():
            start, end = self.tokens[i][1], self.tokens[i + n - 1][2]
            if self.forms[i : i + n] == wanted.forms and self.text[start:end] == wanted.text:
                yield Span(i, i + n, start, end)

    def span(self, phrase: object, occurrence: object = 1, within: Span | None = None) -> Span | None:
        found = list(self.spans(str(phrase or ""), within))
        n = occurrence if isinstance(occurrence, int) else 1
        return found[n - 1] if 0 < n <= len(found) else None

    def marked(self, span: Span) -> bool:
        return any(kind == "marker" for kind, _, _ in self.tokens[span.first : span.last])

    def put(self, span: Span, text: str) -> "Passage":
        return Passage(self.text[: span.start] + text + self.text[span.end :])

    def sentences(self) -> list[Span]:
        """Spans that end with a full stop, a question or an exclamation mark and the closing signs after it."""
        out, first, ended = [], 0, False
        for i, (form, (kind, _, _)) in enumerate(zip(self.forms, self.tokens, strict=True)):
            if ended and (kind != "sign" or form in "([«“‘"):
                out.append((first, i))
                first, ended = i, False
            ended = ended or form in ".?!"
        if first < len(self.forms):
            out.append((first, len(self.forms)))
        return [Span(a, b, self.tokens[a][1], self.tokens[b - 1][2]) for a, b in out]


@dataclass
class Findings:
    """What does not hold: of substance, or of form and so open to a stated deviation."""

    substance: list[str] = field(default_factory=list)
    form: list[str] = field(default_factory=list)

    def note(self, holds: object, message: str, form: bool = False) -> bool:
        if not holds:
            (self.form if form else self.substance).append(message)
        return bool(holds)


class Unlicensed(ValueError):
    """A derivation that the rules do not allow; the message has every finding."""


@dataclass
class Edit:
    """The wording of a piece while its operations are applied."""

    now: Passage
    source: Passage
    pairs: list[dict]
    whole_statement: bool  # the source sentence of the span ends in a full stop


Applied = tuple[Passage | None, str]  # the new wording, or None where the operation is not allowed; and what was done


def _deleted(e: Edit, op: dict) -> Applied:
    span = e.now.span(op.get("text"), op.get("occurrence", 1))
    if span is None:
        return None, "deleted words that are not there"
    new = e.now.put(span, " " if e.now.text[span.start - 1 : span.start].isspace() or e.now.text[span.end : span.end + 1].isspace() else "")
    gone = len(Passage(e.now.text[span.start : span.end]).words())
    return (new if len(new.words()) == len(e.now.words()) - gone else None), f"without “{e.now.text[span.start : span.end]}”"


def _same_noun(a: str, b: str) -> bool:
    """One is the other's plural by -s, -es or -y to -ies."""
    short, long = sorted((a, b), key=len)
    return long in (short + "s", short + "es", short.removesuffix("y") + "ies" if short.endswith("y") else short + "s")


def _agrees(e: Edit, old: str, new: str) -> bool:
    a, b = old.lower(), new.lower()
    return old[:1].isupper() == new[:1].isupper() and (_same_noun(a, b) or (a, b) in AGREEING or (b, a) in AGREEING)


def _named(e: Edit, old: str, new: str) -> bool:
    """A pronoun gives way to words of the source, which may be in the genitive."""
    bare = re.sub(r"['’]s?$", "", new)
    return old.lower() in PRONOUNS and (e.source.span(new) is not None or e.source.span(bare) is not None)


INFLECTIONS: dict[str, Callable[[Edit, str, str], bool]] = {"agreement": _agrees, "antecedent": _named}


def _inflected(e: Edit, op: dict) -> Applied:
    old, new = str(op.get("from") or ""), str(op.get("to") or "")
    span, allowed = e.now.span(old, op.get("occurrence", 1)), INFLECTIONS.get(op.get("kind"))
    ok = span is not None and new and allowed is not None and allowed(e, old, new)
    return (e.now.put(span, new) if ok else None), f"{op.get('kind')} “{old}” to “{new}”"


def _cased(e: Edit, op: dict) -> Applied:
    at = next((i for i, c in enumerate(e.now.text) if c.isalpha()), None)
    if at is None or op.get("to") not in ("upper", "lower"):
        return None, "case"
    c = e.now.text[at]
    return Passage(e.now.text[:at] + (c.upper() if op["to"] == "upper" else c.lower()) + e.now.text[at + 1 :]), "case"


def _requoted(e: Edit, op: dict) -> Applied:
    plain = lambda t: "".join(_QUOTES.get(c, c) for c in t)
    new = Passage(op.get("result"))
    return (new if plain(new.text) == plain(e.now.text) else None), "quotation marks"


def _stopped(e: Edit, op: dict) -> Applied:
    return (Passage(e.now.text.rstrip(" ,;:") + ".") if e.whole_statement else None), "full stop"


def _parted(e: Edit, op: dict) -> Applied:
    span = e.now.span(";", op.get("occurrence", 1))
    rest = e.now.text[span.end :].lstrip() if span else ""
    return (Passage(f"{e.now.text[: span.start].rstrip()}. {rest[0].upper()}{rest[1:]}") if rest[:1].isalpha() else None), "semicolon to full stop"


def _paired(e: Edit, op: dict) -> Applied:
    old, new = str(op.get("from") or ""), str(op.get("to") or "")
    span = e.now.span(old, op.get("occurrence", 1))
    return (e.now.put(span, new) if span and {"from": old, "to": new} in e.pairs else None), f"“{old}” as “{new}”"


def _spaced(e: Edit, op: dict) -> Applied:
    old, new = str(op.get("from") or ""), str(op.get("to") or "")
    span = e.now.span(old, op.get("occurrence", 1))
    return (e.now.put(span, new) if span and new != old and "".join(new.split()) == old else None), f"space in “{new}”"


NORMALISATIONS: dict[str, Callable[[Edit, dict], Applied]] = {"case": _cased, "quotes": _requoted, "end-stop": _stopped, "semicolon": _parted, "pair": _paired, "space": _spaced}


def _normalised(e: Edit, op: dict) -> Applied:
    do = NORMALISATIONS.get(op.get("rule"))
    return do(e, op) if do else (None, f"unknown rule {op.get('rule')!r}")


OPERATIONS: dict[str, Callable[[Edit, dict], Applied]] = {"DELETE": _deleted, "INFLECT": _inflected, "NORMALISE": _normalised}


@dataclass
class Step:
    """A step of the argument; ``supports`` is the step it is needed for, the goal at last."""

    id: Any
    supports: Any = None
    status: Any = None
    why: Any = None
    claim: str = ""
    missing: str = ""
    text: str = ""
    licence: dict = field(default_factory=dict)

    @classmethod
    def read(cls, raw: dict) -> "Step":
        return cls(raw.get("id"), raw.get("supports"), raw.get("status"), raw.get("why"), raw.get("claim") or "", raw.get("missing") or "", raw.get("text") or "", raw.get("licence") or {})

    def notice(self) -> str:
        """What a reader is told where a step is no source's own."""
        return {"gap": f"⟦GAP: {self.missing}⟧", "ai": f"⟦AI-authored link: {self.text}⟧"}.get(self.status, "")


@dataclass
class Derivation:
    sources: dict[str, Passage]
    about: dict[str, dict]
    steps: dict[Any, Step]
    repeated: list[Any]
    sentences: list[dict]
    checks: dict[str, str]
    conclusion: str
    pairs: list[dict]
    by_model: Any

    @classmethod
    def read(cls, raw: Any) -> "Derivation":
        raw = raw if isinstance(raw, dict) else {}
        about = {k: v if isinstance(v, dict) else {} for k, v in (raw.get("sources") or {}).items()}
        steps = [Step.read(s) for s in raw.get("steps") or []]
        times = Counter(s.id for s in steps)
        checks = {c.get("source"): c.get("result") for c in raw.get("checks") or []}
        return cls({k: Passage(v.get("text")) for k, v in about.items()}, about, {s.id: s for s in steps}, [i for i, n in times.items() if n > 1 or not i], list(raw.get("sentences") or []), checks, raw.get("conclusion") or "", list(raw.get("normalisations") or []), raw.get("ai_allowed", []))

    def licensed(self, step: Step) -> Span | None:
        source = self.sources.get(step.licence.get("source"))
        span = source.span(step.licence.get("text"), step.licence.get("occurrence", 1)) if source else None
        return None if span is None or source.marked(span) else span

    def reaches_goal(self, step: Step) -> bool:
        at, left = step.supports, len(self.steps)
        while at != GOAL and at in self.steps and left:
            at, left = self.steps[at].supports, left - 1
        return at == GOAL


StepRule = tuple[str, Callable[[Step, Derivation], object]]
#: What holds of every step but the goal, and what its state demands besides.
STEP_RULES: list[StepRule] = [
    ("says why it is needed", lambda s, d: s.why),
    ("leads to the conclusion", lambda s, d: d.reaches_goal(s)),
    ("has a known state", lambda s, d: s.status in STATES),
]
STATE_RULES: dict[str, list[StepRule]] = {
    "part": [("is a part of the conclusion itself", lambda s, d: s.supports == GOAL)],
    "stated": [("has words of a source as its licence", lambda s, d: d.licensed(s)), ("links to a step", lambda s, d: s.supports in d.steps)],
    "gap": [("names what is missing, from → to", lambda s, d: "→" in s.missing)],
    "ai": [
        ("names what is missing, from → to", lambda s, d: "→" in s.missing), ("is allowed to a model", lambda s, d: d.by_model == "all" or s.id in d.by_model), ("links to a step", lambda s, d: s.supports in d.steps),
        ("has words without figures, quotations and references", lambda s, d: s.text and not re.search(r"[\d\"“”]|\[S", s.text)),
    ],
}
DERIVATION_RULES: list[tuple[str, Callable[[Derivation], object]]] = [
    ("There are sources", lambda d: d.sources),
    ("Every source has a text", lambda d: all(p.text for p in d.sources.values())),
    ("Every source has a check", lambda d: all(d.checks.get(k) for k in d.sources)),
    ("There are steps, each with an id of its own", lambda d: d.steps and not d.repeated),
    ("There is a conclusion", lambda d: d.conclusion),
    ("The goal supports nothing", lambda d: GOAL not in d.steps or not d.steps[GOAL].supports and not d.steps[GOAL].status),
    ("Every step has a sentence", lambda d: set(d.steps) <= {i for s in d.sentences for i in _ids(s)}),
    ("Every sentence has known steps", lambda d: all(_ids(s) and set(_ids(s)) <= set(d.steps) for s in d.sentences)),
]


def _ids(sentence: dict) -> list:
    step = sentence.get("step")
    return list(step) if isinstance(step, list) else [step]


@dataclass
class Built:
    """A sentence as read: its text, the spans it is made of by source, how, and the forms it waives."""

    text: str = ""
    used: list[tuple[str, Span]] = field(default_factory=list)
    how: list[str] = field(default_factory=list)
    waived: list[str] = field(default_factory=list)


def _piece(d: Derivation, piece: dict, name: str, found: Findings, out: Built) -> str:
    """The wording of one piece, empty where it is not allowed."""
    source = d.sources.get(piece.get("source"))
    if not found.note(source, f"{name}: unknown source {piece.get('source')!r}"):
        return ""
    within = None
    if piece.get("link") is not None:
        step = d.steps.get(piece["link"])
        own = step is not None and step.status == "stated" and step.licence.get("source") == piece["source"]
        if found.note(own, f"{name}: a connective without a stated licence of its source", form=True):
            within = d.licensed(step)
    span = source.span(piece.get("text"), piece.get("occurrence", 1), within)
    if not found.note(span, f"{name}: {piece.get('text')!r} is not in {piece['source']} as whole words") or not found.note(not source.marked(span), f"{name}: {piece.get('text')!r} holds a marker"):
        return ""
    ends = next((source.text[s.start : s.end] for s in source.sentences() if s.meets(span)), "")
    edit = Edit(Passage(source.text[span.start : span.end]), source, d.pairs, ends.rstrip("”’\"')]»").endswith("."))
    done = []
    for op in piece.get("ops") or []:
        do = OPERATIONS.get(op.get("op"))
        new, what = do(edit, op) if do else (None, "")
        if not found.note(new, f"{name}: {op.get('op')} is not allowed: {what}"):
            return ""
        edit = replace(edit, now=new)
        done.append(what)
    out.used.append((piece["source"], span))
    out.how.append(f"{piece['source']} {span.start}-{span.end}" + (f" as connective of {piece['link']}" if piece.get("link") is not None else "") + (f" ({'; '.join(done)})" if done else ""))
    found.note(edit.now.text, f"{name}: nothing is left of {piece.get('text')!r}")
    return edit.now.text


def build(d: Derivation, number: int, sentence: dict, found: Findings) -> Built:
    """Sentence ``number`` from its pieces; findings of form go to the sentence if it states a deviation."""
    name, out, own = f"Sentence {number}", Built(), Findings()
    content_before = False
    pieces = list(sentence.get("pieces") or [])
    own.note(any(p.get("link") is None for p in pieces), f"{name}: no content")
    for p in pieces:
        content = p.get("link") is None
        own.note(not (content and content_before), f"{name}: content follows content without a connective", form=True)
        content_before = content
        words = _piece(d, p, name, own, out)
        out.text += words if not out.text or words[:1] in tuple(",.;:!?)]”’»") else f" {words}"
    letters = [c for c in out.text if c.isalpha()]
    own.note(not letters or not letters[0].islower(), f"{name}: begins with a small letter", form=True)
    bare = out.text.rstrip("”’\"')]»")
    if own.note(bare[-1:] in (".", "?", "!"), f"{name}: ends without a full stop", form=True) and bare:
        at = len(bare) - 1
        out.text = f"{out.text[:at]} [{'; '.join(dict.fromkeys(k for k, _ in out.used))}]{out.text[at:]}"
    else:
        out.text += f" [{'; '.join(dict.fromkeys(k for k, _ in out.used))}]"
    if sentence.get("deviation"):
        out.waived, own.form = own.form, []
    found.substance += own.substance
    found.form += own.form
    return out


def coverage(source: Passage, used: list[Span]) -> tuple[int, int]:
    """How many of a source's sentences the spans touch, and how many it has."""
    sentences = source.sentences()
    return sum(any(s.meets(u) for u in used) for s in sentences), len(sentences)


def render(raw: Any) -> dict:
    """The four parts of a derivation (synthesis, references, provenance, reasoning), its deviations and how many source sentences it uses.

    Raises ``Unlicensed`` with all findings where a rule does not hold.
    """
    d, found = Derivation.read(raw), Findings()
    for message, holds in DERIVATION_RULES:
        found.note(holds(d), f"Not so: {message}")
    for s in d.steps.values():
        for message, holds in (*STEP_RULES, *STATE_RULES.get(s.status, ())) if s.id != GOAL else ():
            found.note(holds(s, d), f"Step {s.id}: not so that it {message}")
    if found.substance:
        raise Unlicensed("; ".join(found.substance))
    built = [build(d, n, s, found) for n, s in enumerate(d.sentences, 1)]
    place = {i: n for n, i in enumerate(d.steps)}
    reached = -1
    for n, (s, b) in enumerate(zip(d.sentences, built, strict=True), 1):
        at = min(place[i] for i in _ids(s))
        if at < reached:
            (b.waived if s.get("deviation") else found.form).append(f"Sentence {n}: out of the order of the steps")
        reached = max(reached, at)
    if found.substance or found.form:
        raise Unlicensed("; ".join(found.substance + found.form))
    last = {i: n for n, s in enumerate(d.sentences) for i in _ids(s)}
    paragraphs: list[list[str]] = []
    provenance, cited = [], []
    for n, (s, b) in enumerate(zip(d.sentences, built, strict=True)):
        if not paragraphs or s.get("paragraph"):
            paragraphs.append([])
        notices = [(i, d.steps[i].notice()) for i in d.steps if last[i] == n and d.steps[i].notice()]
        paragraphs[-1] += [b.text, *(text for _, text in notices)]
        provenance += [f"{n + 1}. " + " + ".join(b.how), *(f"{n + 1}. {d.steps[i].status} for {i} → {d.steps[i].supports}" for i, _ in notices)]
        cited += [k for k, _ in b.used] + [k for _, text in notices for k in d.sources if k in Passage(text.strip("⟦⟧")).words()]
    covered = {k: coverage(p, [u for b in built for label, u in b.used if label == k]) for k, p in d.sources.items()}
    of = lambda k: ", ".join(str(d.about[k][x]) for x in ("author", "title", "locator") if d.about[k].get(x))
    chain = [f"{i} → {s.supports} [{s.status}] {s.claim}: {s.why}" for i, s in d.steps.items() if i != GOAL]
    return {
        "synthesis": "\n\n".join(" ".join(p) for p in paragraphs), "references": "\n".join(f"[{k}] {of(k)}" for k in dict.fromkeys(cited)), "provenance": "\n".join(provenance),
        "reasoning": "\n".join([f"{GOAL}: {d.conclusion}", *chain, *(f"{k}: {a} of {n} sentences; {d.checks[k]}" for k, (a, n) in covered.items())]),
        "deviations": [f"{n}: {s['deviation']} ({'; '.join(b.waived)})" for n, (s, b) in enumerate(zip(d.sentences, built, strict=True), 1) if s.get("deviation")], "used_sentences": sum(a for a, _ in covered.values()),
    }


_RESULT = StructType([*(StructField(k, StringType()) for k in ("synthesis", "references", "provenance", "reasoning")), StructField("deviations", ArrayType(StringType())), StructField("used_sentences", LongType()), StructField("refused", StringType())])


@F.pandas_udf(_RESULT)
def render_derivation(column: pd.Series) -> pd.DataFrame:
    """Renders JSON derivations; ``refused`` has the findings of one that is not allowed or no JSON, a null gives nulls."""
    blank = dict.fromkeys(_RESULT.names)
    rows = []
    for text in column:
        try:
            rows.append(blank | (render(json.loads(text)) if text is not None else {}))
        except (ValueError, AttributeError, TypeError, KeyError) as e:
            rows.append(blank | {"refused": str(e) or type(e).__name__})
    out = pd.DataFrame(rows, columns=_RESULT.names).astype(object)
    out["used_sentences"] = out["used_sentences"].astype("Int64")
    return out
