"""Finding, resolving and rewriting typed spans inside a text column.

Each rule scans the text on its own; then the leftmost start wins, rule order
breaks ties at the same start, and a span that begins before the end of the
previous one is dropped. All of it is a ``Column`` expression, so the stage
needs no shuffle in batch and no state in a stream. The resolving fold costs
time quadratic in the number of spans of one cell, hence texts are cut to
segments of a few hundred characters first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import ENDS_WORD, SPACE, STARTS_WORD, WORD, has, let, squash
from .readings import spoken
from .words import word_list

_D = r"\p{Nd}"
_S = f"[{SPACE}]"
_B, _E = STARTS_WORD, ENDS_WORD
_EDGE = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


@dataclass(frozen=True)
class Rule:
    """A span class, its pattern and what a text must hold for it to match at all."""

    cls: str
    pattern: str
    digit: bool
    needles: tuple[str, ...] = ()
    precheck: str = ""


# Abbreviations before a full stop, and those that also stand without one.
_ABBREVIATED = (
    r"Mr|Mrs|Ms|Dr|Prof|St|Jr|Sr|Ave|Blvd|Rd|Ln|Mt|Vol|Ch|Fig|Dept|Govt|Inc|Ltd|Corp|approx|vs|etc|e\.g|i\.e"
)
_PLACES = "St|Ave|Blvd|Rd|Dr|Ln|Mt"

# The twelve span patterns in order of priority. Numbers are taken possessively
# where what follows cannot start inside them, so no shorter number is ever tried.
RULES = [
    Rule(
        "ELECTRONIC",
        rf"(?:https?://|www\.)[^{SPACE}]*[{WORD}/]"
        rf"|{_EDGE}[{WORD}.+-]+@[{WORD}-]+\.[{WORD}.-]*[{WORD}]{_E}",
        digit=False,
        needles=("://", "www.", "@"),
    ),
    Rule(
        "MONEY",
        rf"[$£€¥]{_S}?{_D}[{_D},]*(?:\.{_D}+)?{_S}?(?:bn|tr|[kKmMbB])?{_EDGE}",
        digit=True,
        needles=("$", "£", "€", "¥"),
    ),
    Rule("TELEPHONE", rf"\(?{_D}{{3}}\)?[{SPACE}.\-]{_D}{{3}}[{SPACE}.\-]{_D}{{4}}{_E}", digit=True),
    Rule("TIME", rf"(?iu)(?={_D}){_B}{_D}{{1,2}}:{_D}{{2}}(?:{_S}?[ap]\.?m\.?)?{_EDGE}", digit=True, needles=(":",)),
    Rule(
        "MEASURE",
        rf"(?={_D}){_B}{_D}[{_D},]*+(?:\.{_D}++)?+{_S}?+(?=[%°kmcGMKTlofhs])(?:%|°[CF]|km/h|mph|kg|km|cm|mm|mg|ml|GB|MB|KB|TB"
        rf"|kHz|MHz|GHz|kW|lbs?|oz|ft|mi|hrs?|min|sec){_E}",
        digit=True,
    ),
    Rule(
        "ROMAN",
        rf"(?iu){_B}(?=\p{{L}}{{3,9}}{_S}+[MDCLXVI]{{1,4}}{_E})(king|queen|pope|louis|henry|george|edward|william|elizabeth|charles|richard"
        rf"|philip|napoleon|peter|catherine|chapter|part|section|book|act|scene|volume|vol|appendix)"
        rf"{_S}+([MDCLXVI]{{1,4}}){_E}",
        digit=False,
        precheck=rf"[^!-~](?<={_S})[MDCLXVImdclxvi\u0130\u0131]{{1,4}}{_E}",
    ),
    Rule("FRACTION", rf"(?={_D}){_B}{_D}++/{_D}++{_E}", digit=True, needles=("/",)),
    Rule("ORDINAL", rf"(?iu)(?={_D}){_B}({_D}++)(?:st|nd|rd|th){_E}", digit=True),
    Rule("DECIMAL", rf"(?=[{_D}.]){_EDGE}{_D}*+\.{_D}++{_E}", digit=True, needles=(".",)),
    Rule("CARDINAL_G", rf"(?={_D}){_B}{_D}{{1,3}}(?:,{_D}{{3}})+{_E}", digit=True, needles=(",",)),
    Rule("CARDINAL", rf"(?={_D}){_B}{_D}++{_E}", digit=True),
    Rule(
        "ABBREV",
        rf"(?d){_B}(?=[A-Za-z]{{2,6}}\.|e\.g|i\.e)(?:{_ABBREVIATED})\.(?={_S}|$|[^{WORD}])"
        rf"|(?=[SABRDLM]){_B}(?:{_PLACES}){_E}(?={_S}+[A-Z])",
        digit=False,
        precheck=rf"(?=[.SABRDLM])(?:\.(?<=(?:{_ABBREVIATED})\.)|(?:{_PLACES}){_E})",
    ),
]

# Unicode noncharacters, reserved for a program's own use; they frame matches below.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"
_PIECE = "array<struct<prio:int,hit:int,rest:int>>"
_PLACED = "array<struct<start:int,prio:int,stop:int>>"


def _shield(text: Column) -> Column:
    """Swap the two frame characters for another of the same length; offsets stay true."""
    framed = has(text, _OPEN, _CLOSE)
    return F.when(framed, F.translate(text, _OPEN + _CLOSE, "\ufffd\ufffd")).otherwise(text)


def _pieces(text: Column, prio: int, rule: Rule) -> Column:
    """One pass of a rule: matches are framed, the text is cut before each frame.

    A piece is a match length and the length of the text after it; the text
    before the first match has match length -1.
    """

    def measure(piece: Column) -> Column:
        close = F.instr(piece, _CLOSE)
        return F.struct(
            F.lit(prio).alias("prio"),
            (close - 1).alias("hit"),
            (F.length(piece) - close).alias("rest"),
        )

    nothing = F.array().cast(_PIECE)
    marked = F.regexp_replace(text, rule.pattern, f"{_OPEN}$0{_CLOSE}")
    pieces = let(
        F.split(marked, _OPEN, -1),
        lambda cut: F.when(F.size(cut) > 1, F.transform(cut, measure)).otherwise(nothing),
    )
    if rule.needles:
        return F.when(has(text, *rule.needles), pieces).otherwise(nothing)
    if rule.precheck:
        return F.when(F.rlike(text, F.lit(rule.precheck)), pieces).otherwise(nothing)
    return pieces


def _place(pieces: Column) -> Column:
    """Turn lengths into offsets; each rule starts again with its first piece."""
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(_PLACED).alias("spans"))

    def step(acc: Column, piece: Column) -> Column:
        stop = acc["pos"] + piece["hit"]
        span = F.struct(acc["pos"].alias("start"), piece["prio"].alias("prio"), stop.alias("stop"))
        return F.when(
            piece["hit"] < 0, F.struct(piece["rest"].alias("pos"), acc["spans"].alias("spans"))
        ).otherwise(
            F.struct((stop + piece["rest"]).alias("pos"), F.array_append(acc["spans"], span).alias("spans"))
        )

    return F.aggregate(pieces, start, step, lambda acc: acc["spans"])


def _resolve(spans: Column) -> Column:
    """Keep spans from the left; one that starts inside a kept span is dropped."""
    start = F.struct(F.lit(-1).alias("stop"), F.array().cast(_PLACED).alias("kept"))

    def step(acc: Column, span: Column) -> Column:
        return F.when(
            span["start"] >= acc["stop"],
            F.struct(span["stop"].alias("stop"), F.array_append(acc["kept"], span).alias("kept")),
        ).otherwise(acc)

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["kept"])


def scan(text: Column, classes: list[str] | None = None, rules: list[Rule] | None = None) -> Column:
    """Resolved spans ``array<struct<start, stop, cls, surface>>`` in text order.

    ``classes`` limits the rules, keeping their relative priority; ``rules``
    replaces the list.
    """
    known = RULES if rules is None else rules
    names = word_list([rule.cls for rule in known])
    active = [(k, rule) for k, rule in enumerate(known) if classes is None or rule.cls in classes]
    nothing = F.array().cast(_PIECE)

    def cut(shielded: Column) -> Column:
        plain = [_pieces(shielded, k, rule) for k, rule in active if not rule.digit]
        numeric = [_pieces(shielded, k, rule) for k, rule in active if rule.digit]
        return F.concat(
            nothing,
            *plain,
            F.when(F.rlike(shielded, F.lit(_D)), F.concat(nothing, *numeric)).otherwise(nothing),
        )

    resolved = let(
        let(_shield(text), cut),
        lambda p: F.when(F.size(p) == 0, F.array().cast(_PLACED)).otherwise(_resolve(_place(p))),
    )
    return F.transform(
        resolved,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["stop"].alias("stop"),
            F.element_at(names, s["prio"] + 1).alias("cls"),
            F.substr(text, s["start"] + 1, s["stop"] - s["start"]).alias("surface"),
        ),
    )


def _may_match(text: Column) -> Column:
    """False only where no rule matches: no digit and nothing of what the other rules ask for."""
    found = F.rlike(text, F.lit(_D))
    for rule in RULES:
        if not rule.digit:
            found = found | (has(text, *rule.needles) if rule.needles else F.rlike(text, F.lit(rule.precheck)))
    return found


def splice(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """Put ``replacement(span)`` in the place of each span. No blanks are added."""

    def put(found: Column) -> Column:
        def piece(span: Column, k: Column) -> Column:
            before = F.when(k == 0, F.lit(0)).otherwise(F.get(found, k - 1)["stop"])
            return F.concat(F.substr(text, before + 1, span["start"] - before), replacement(span))

        tail = F.substr(text, F.element_at(found, -1)["stop"] + 1)
        return F.when(F.size(found) == 0, text).otherwise(
            F.concat(F.array_join(F.transform(found, piece), ""), tail)
        )

    return let(spans, put)


def normalize(text: Column) -> Column:
    """Spoken form of a written text; the scan, whose lambdas are not compiled, only runs where a rule may match."""
    spans = scan(text)
    said = splice(text, spans, lambda s: spoken(s["cls"], s["surface"]))
    return squash(F.when(_may_match(text), said).otherwise(text))
