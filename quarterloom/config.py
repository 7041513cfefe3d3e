"""What defines a panel task: items, lags, horizons, splits. All of it is parameters."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields, replace

# The item lists of the public task definition, in its order.
BALANCE_SHEET = (
    "cheq invtq rectq acoq actq gdwlq intanoq intanq ppentq dpactq ppegtq aoq ancq atq "
    "apq lcoq dlcq txpq drcq lctq drltq dlttq txditcq loq ltq "
    "cstkq capsq req acomincq tstkq ceqq pstkq seqq mibtq"
).split()
INCOME = "revtq cogsq xsgaq xrdq dpq stkcoq oibdpq oiadpq xintq nopiq spiq piq txtq miiq ibq xidoq niq xoprq".split()
CASH_FLOW = "fopoq oancfq capxq ivchq aqcq sivq sppeq ivstchq ivacoq ivncfq sstkq prstkcq dltisq dltrq dvq dlcchq txbcofq fiaoq fincfq exreq".split()
COMPUTED = "gpq fcfq wcapq aoq_ex_intanq loq_ex_dr xsgaq_ex_rd".split()
CORE = "revtq cogsq oiadpq niq dpq cheq ppentq atq ltq seqq dlttq gpq".split()
# The public definition gives the next set its own name; rules of this repository ask for a neutral one.
STATEMENTS = (
    "cheq invtq rectq acoq gdwlq ppentq aoq atq apq lcoq dlcq drltq dlttq txdbq loq ltq cstkq capsq req tstkq ceqq pstkq seqq mibq "
    "revtq cogsq xsgaq xrdq dpq oibdpq oiadpq xintq nopiq piq txtq niq xoprq "
    "fopoq oancfq capxq ivchq aqcq ivacoq ivncfq sstkq prstkcq dltisq dltrq dvq fiaoq fincfq intpnq txpdq gpq fcfq aociq"
).split()
GLM = (
    "revtq cogsq xsgaq dpq xintq nopiq spiq txtq miiq xidoq dvpq rectq invtq acoq ppentq intanq aoq dlcq apq txpq lcoq dlttq txditcq loq mibtq acomincq "
    "sstkq prstkcq dvq neiq dvcq"
).split()
#: Items reported as running totals of the fiscal year, without their last letter.
YTD_BASES = "fopo oancf capx ivch aqc ivaco siv sppe ivstch ivncf sstk prstkc dltis dltr dv dlcch txbcof fiao fincf intpn txpd exre".split()

_FULL = [*BALANCE_SHEET, *INCOME, *CASH_FLOW, *COMPUTED]
_ABSENT_EARLY = {"txbcofq", "stkcoq", "drcq", "drltq", "acomincq", "loq_ex_dr"}
FEATURE_SETS: dict[str, list[str]] = {
    "core": CORE,
    "statements": STATEMENTS,
    "pf_full": _FULL,
    "pf_avail": [i for i in _FULL if i not in _ABSENT_EARLY],
    "pf_full2": [*BALANCE_SHEET, *INCOME[:-1], "dvpq", INCOME[-1], *(i for i in CASH_FLOW if i != "dvq"), *COMPUTED, "dvcq"],
    "glm": GLM,
    "pf_full_glm": list(dict.fromkeys([*_FULL, *GLM])),
}
#: name: (left item, right item, how nulls count). "strict": null if either is;
#: "right0": a missing right side is 0; "both0": either missing side is 0.
COMPUTED_ITEMS: dict[str, tuple[str, str, str]] = {
    "gpq": ("revtq", "cogsq", "strict"),
    "fcfq": ("oancfq", "capxq", "strict"),
    "dvcq": ("dvq", "dvpq", "strict"),
    "wcapq": ("actq", "lctq", "strict"),
    "aoq_ex_intanq": ("aoq", "intanq", "right0"),
    "loq_ex_dr": ("loq", "drltq", "right0"),
    "xsgaq_ex_rd": ("xsgaq", "xrdq", "right0"),
    "neiq": ("sstkq", "prstkcq", "both0"),
}
#: Columns a raw panel may spell otherwise.
RAW_ALIASES = {"gvkey": "firm_id", "datadate": "date", "sich": "sic", "naicsh": "naics"}


@dataclass(frozen=True)
class Scale:
    """Size of a row: sum of absolute items plus a constant, or else a fallback's."""

    add: tuple[str, ...] = ("ltq", "seqq")
    fallbacks: tuple[str, ...] = ("atq",)
    constant: float = 1e-3


@dataclass(frozen=True)
class StatLags:
    """Lags, in surviving rows, of the scale and of the item in a pool of ratios."""

    scale: int
    item: tuple[int, ...]


@dataclass(frozen=True)
class Task:
    """A panel task. The defaults are the public benchmark's."""

    items: tuple[str, ...] = tuple(FEATURE_SETS["pf_full"])
    first_year: int = 1970
    last_year: int = 2024
    train_end: int = 2001
    val_end: int = 2009
    horizon: int = 20
    min_lookback: int = 4
    levels: int = 4
    yoy: int = 8
    clamp: float = 6.0
    #: A year-over-year change is a difference of two normals: its bound is this much wider.
    yoy_factor: float = 1.4142
    period: int = 4
    mu: StatLags = StatLags(0, (0,))
    sigma: StatLags = StatLags(4, (0, 8))
    k: StatLags = StatLags(4, (0, 8))
    factors: int = 10
    impute: bool = True
    present_in_q0: bool = True
    scale: Scale = field(default_factory=Scale)
    excluded_sic: tuple[tuple[int, int], ...] = ((6000, 6999),)
    row_filters: tuple[tuple[str, str], ...] = (("indfmt", "INDL"), ("datafmt", "STD"), ("consol", "C"), ("popsrc", "D"))
    link_types: tuple[str, ...] = ("LU", "LC")
    link_primary: tuple[str, ...] = ("P", "C")
    industries: int = 48
    fade_min_rows: int = 100
    tuple_history: int = 11


#: The groups of a feature set's definition, in the order in which their items count.
GROUPS = ("balance_sheet", "income_statement", "cash_flow", "computed")


def resolve_sets(specs: Mapping[str, Mapping]) -> dict[str, list[str]]:
    """Flat item lists from definitions of groups and ``include_sets``.

    An included set's items come before a set's own; the first mention of an item counts. A
    set that includes itself, also through others, is entered once. An unknown set is an error.
    """

    def walk(name: str, seen: set[str]) -> Iterable[str]:
        if name not in specs:
            raise KeyError(f"unknown feature set {name!r}; known: {', '.join(sorted(specs))}")
        if name in seen:
            return
        seen.add(name)
        for other in specs[name].get("include_sets") or ():
            yield from walk(other, seen)
        for group in GROUPS:
            yield from specs[name].get(group) or ()

    return {name: list(dict.fromkeys(walk(name, set()))) for name in specs}


def load_document(path: str) -> dict:
    """A JSON document, or a YAML one where a YAML parser is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if not path.endswith((".yaml", ".yml")):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError(f"{path} is YAML and no parser for it is installed; JSON works") from e
    return yaml.safe_load(text)


def load_feature_sets(path: str) -> dict[str, list[str]]:
    """The built-in sets and those a document defines (at its top, or under ``feature_sets``)."""
    doc = load_document(path)
    built_in = {name: {GROUPS[0]: items} for name, items in FEATURE_SETS.items()}
    return resolve_sets({**built_in, **doc.get("feature_sets", doc)})


def load_task(path: str, task: Task | None = None) -> Task:
    """A task whose fields a document overrides; ``feature_set`` names its items.

    Lists become tuples; the nested ``scale``, ``mu``, ``sigma`` and ``k`` are objects. A
    field that doesn't exist is an error.
    """
    doc, task = dict(load_document(path)), task or Task()
    sets = resolve_sets({**{n: {GROUPS[0]: i} for n, i in FEATURE_SETS.items()}, **doc.pop("feature_sets", {})})
    if "feature_set" in doc:
        name = doc.pop("feature_set")
        if name not in sets:
            raise KeyError(f"unknown feature set {name!r}; known: {', '.join(sorted(sets))}")
        doc["items"] = sets[name]
    unknown = set(doc) - {f.name for f in fields(Task)}
    if unknown:
        raise ValueError(f"{path}: no such fields: {', '.join(sorted(unknown))}")
    frozen = lambda v: tuple(map(frozen, v)) if isinstance(v, list) else v
    kinds = {"scale": Scale, "mu": StatLags, "sigma": StatLags, "k": StatLags}
    return replace(task, **{k: kinds[k](**{a: frozen(b) for a, b in v.items()}) if k in kinds else frozen(v) for k, v in doc.items()})


def raw_columns(items: list[str] | tuple[str, ...], ytd: bool = True, keys: tuple[str, ...] = ("gvkey", "datadate", "fyearq", "fqtr", "sich", "naicsh"), scale: Scale | None = None) -> list[str]:
    """The columns a build reads, once each, in stable order.

    Keys, then every item or, for computed ones, their inputs; items that exist as
    running totals are read as ``{base}y``.
    """
    scale = scale or Scale()
    out: list[str] = list(keys)
    totals = {f"{b}q": f"{b}y" for b in YTD_BASES}
    for item in [*items, *scale.add, *scale.fallbacks]:
        for c in COMPUTED_ITEMS[item][:2] if item in COMPUTED_ITEMS else (item,):
            out.append(totals.get(c, c) if ytd else c)
    return list(dict.fromkeys(out))


def year_chunks(first: int, last: int, years: int) -> list[tuple[int, int]]:
    """Inclusive windows of ``years`` years that cover first..last."""
    if years < 1:
        raise ValueError("a chunk has at least one year")
    if last < first:
        raise ValueError(f"{last} is before {first}")
    return [(y, min(y + years - 1, last)) for y in range(first, last + 1, years)]
