"""Word tables of credit prose, and the few shapes in which they are looked for.

Every pattern is made of plain words by `words`, `near`, `before` and `phrase`, and uses only what both Spark's and
DuckDB's regular expressions know, so that a query and its SQL twin read a sentence by one table.
"""

from __future__ import annotations

from collections.abc import Iterable


def forms(verbs: str) -> list[str]:
    """Regular forms of each verb: raise, raises, raised, raising."""
    out = []
    for v in verbs.split():
        stem = v[:-1] if v.endswith("e") else v
        out += [v, f"{v}s", f"{stem}ed", f"{stem}ing"]
    return out


def words(some: Iterable[str] | str) -> str:
    """Any of the words or phrases, longest first; a space in a phrase is any white space or a hyphen."""
    some = some.split() if isinstance(some, str) else list(some)
    return "(?:" + "|".join(r"[\s-]+".join(w.split()) for w in sorted(some, key=lambda w: (-len(w), w))) + ")"


def phrase(*parts: Iterable[str] | str) -> str:
    """The parts one after the other, case aside."""
    return r"(?i)\b" + r"\s+".join(words(p) for p in parts) + r"\b"


def _led(first: Iterable[str] | str, then: str, gap: int, between: str) -> str:
    """One of `first`, at most gap - 1 words, `then`. A figure after "may" makes it a month."""
    some = first.split() if isinstance(first, str) else list(first)
    plain = [x for x in some if x != "may"]
    found = [rf"(?i)\b{words(plain)}\b(?:{between}\w+){{0,{gap - 1}}}?{between}{then}\b"] if plain else []
    if "may" in some:
        more = rf"(?:{between}[^\W\d]\w*(?:{between}\w+){{0,{gap - 2}}}?)?" if gap > 1 else ""
        found.append(rf"(?i)\bmay\b{more}{between}{then}\b")
    return "|".join(found)


def near(first: Iterable[str] | str, then: Iterable[str] | str, gap: int) -> str:
    """A word of `then` at most `gap` words after one of `first`, in the same clause."""
    return _led(first, words(then), gap, r"[^\w.;]+")


def either(a: Iterable[str] | str, b: Iterable[str] | str, gap: int) -> str:
    """Both, in any order."""
    return f"{near(a, b, gap)}|{near(b, a, gap)}"


def before(some: Iterable[str] | str, marker: Iterable[str] | str, within: int) -> str:
    """One of `some` among the `within` words before a marker."""
    return _led(some, words(marker), within, r"\W+")


# Statuses of guidance by verb, and what the verbs are about.
PLANS = "outlook guidance forecast target targets".split()
GUIDANCE = {
    "reaffirmed": near(forms("confirm reaffirm maintain reiterate uphold"), [*PLANS, "expectations"], 9),
    "in_line": near(["in line with"], [*PLANS, "expectations"], 6),
    "raised": near(forms("raise increase lift upgrade"), PLANS, 9),
    "cut": near([*forms("lower reduce downgrade"), "cut", "cuts", "cutting", *(f"{v} {d}" for v in forms("revise") for d in ("down", "downward", "downwards"))], PLANS, 9),
    "withdrawn": near("withdraw withdraws withdrew withdrawn withdrawing", PLANS, 6),
}

#: Words one of which every pattern of guidance needs.
GUIDANCE_NEEDS = [*PLANS, "expectations"]

# Words of doubt, breach, impairment and strained liquidity; of denial, supposition, conclusion and relief.
WEIGHTY = "substantial significant material".split()
DOUBTS = [f"{w} {d}" for w in WEIGHTY for d in ("doubt", "uncertainty", "uncertainties")]
UNABLE = [f"{x} to continue as a going concern" for x in ("unable", "not be able")]
BREACH = [*forms("breach violate"), "breaches", "violation", "violations", "non compliance", "noncompliance", "not in compliance"]
COVENANT = "covenant covenants".split()
STRAIN = "concern concerns constraint constraints constrained shortfall shortfalls pressure pressures tightened tightening strained insufficient".split()
NEGATIONS = [*"no not without never neither nor".split(), "free of", "absence of"]
MODALS = "may might could would can if when should unless potential future any".split()
EVALUATION = [*forms("evaluate assess"), "evaluation", "assessment", "whether"]
CONCLUSIONS = "concluded determined identified believes".split()
RELIEF = "alleviate alleviates alleviated mitigate mitigates mitigated".split()
NOT_YET = "not cannot may might could would will when to intended designed expected sufficient probable whether if unless should".split()

DOUBT = f"(?i)\\b{words([*DOUBTS, *UNABLE])}\\b"
FLAGS = {
    "going_concern": f"{either(DOUBTS, ['going concern'], 18)}|{phrase(UNABLE)}",
    "covenant": either(BREACH, COVENANT, 9),
    "impairment": either(WEIGHTY, ["impairment", "impairments"], 6),
    "liquidity": f"{near(['liquidity'], STRAIN, 5)}|{phrase(['constrained', 'tight', 'strained', 'insufficient'], ['liquidity'])}",
}
#: Words one of which every flag needs: unable and able begin what UNABLE names.
FLAGS_NEED = [*COVENANT, "doubt", "uncertainty", "uncertainties", "unable", "able", "impairment", "impairments", "liquidity"]
#: What each flag's marker is, for a negation within five words before it.
MARKERS = {"going_concern": [*DOUBTS, *UNABLE], "covenant": BREACH, "impairment": [f"{w} impairment" for w in WEIGHTY], "liquidity": ["liquidity", *STRAIN]}
#: What is denied after its own negation: nothing casts doubt, nobody is affected or in default.
UNTOUCHED = [*forms("affect impact expose"), "cast", "in breach", "in default"]
DENIED = {flag: before([n for n in NEGATIONS if n != "not"] if flag == "covenant" else NEGATIONS, marker, 5) + "|" + near(["not"], UNTOUCHED, 1) for flag, marker in MARKERS.items()}
SUPPOSED = {flag: before(MODALS, marker, 6) + f"|{near(MARKERS[flag], ['if', 'could', 'might', 'may', 'would'], 2)}" for flag, marker in MARKERS.items()}

DOUBT_DENIED = before(NEGATIONS, [*DOUBTS, *UNABLE], 5)
DOUBT_SUPPOSED = before(MODALS, [*DOUBTS, *UNABLE], 6)
DOUBT_WEIGHED = before(EVALUATION, [*DOUBTS, *UNABLE], 20)
DOUBT_CONDITION = rf"(?i)^\W*{words(['if', 'should', 'unless', 'were'])}\b"
DOUBT_CONCLUDED = before(CONCLUSIONS, [*DOUBTS, *UNABLE], 30)
RELIEVED, RELIEF_OPEN = phrase(RELIEF), before(NOT_YET, RELIEF, 4)

# Liquidity topics and worries, covenant compliance and anticipation, resolutions.
LIQUIDITY_TOPIC = f"(?i)\\b{words(['liquidity', 'cash', 'credit line', 'credit lines', 'credit facility', 'credit facilities', 'line of credit', 'lines of credit', 'revolving', 'liquid assets'])}\\b"
WORRY = [*STRAIN, *forms("weaken deteriorate"), "tight", "stress", "stressed", "squeeze", "deterioration", "insufficiency", "uncertainty", "uncertainties", "substantial doubt", "at risk", "risk of", *(f"unable to {v}" for v in ("meet", "fund", "service", "repay"))]
WORRY += [f"{d} {v}" for d in ("difficulty", "difficulties", "difficulty in", "difficulties in") for v in ("meeting", "funding", "refinancing")]
WORRY += [f"{d} {p} liquidity" for d in [*forms("reduce"), "reduction"] for p in ("in", "of", "of our", "in our", "our")]
WORRIED, WORRY_DENIED = phrase(WORRY), before(NEGATIONS, WORRY, 5)
NOT_ENOUGH = near("not no never cannot", ["sufficient", "adequate", "enough", "assurance", "able to meet", "able to maintain", "able to fund"], 9)
ADVERSE = near(MODALS[:4], [f"adversely {v}" for v in forms("affect impact")], 3)
COMPLIANT = f"{phrase(['are', 'were', 'is', 'was', 'remain', 'remains', 'remained'], ['in compliance'])}|{phrase(['complied with'])}|{before(['no'], ['breach', 'violation', 'default', 'event of default'], 4)}|{phrase(['not in'], ['breach', 'default'])}"
ANTICIPATED = f"{near(['will'], ['not remain in compliance', 'not be in compliance'], 1)}|{near(['may', 'might', 'could'], ['breach', 'not comply', 'result in a breach'], 3)}|{near(forms('anticipate expect'), ['non compliance', 'breach', 'not be in compliance', 'unable to comply'], 6)}|{phrase(['risk of'], ['breach', 'default', 'a breach', 'non compliance'])}|{phrase(['unable to'], ['comply', 'meet', 'maintain'])}"
#: A default is a breach where the sentence ties it to a covenant or to compliance.
DEFAULTS = either(["event of default", "events of default"], ["covenant", "covenants", "compliance"], 12)
BREACHED = f"{phrase(BREACH)}|{phrase(['failed to', 'failure to', 'did not'], ['comply', 'meet', 'maintain', 'satisfy'])}|{phrase(['has', 'have', 'had'], ['not met'])}|{DEFAULTS}"
_BREACHES = [*BREACH, "event of default", "events of default"]
BREACH_DENIED, BREACH_SUPPOSED = before([n for n in NEGATIONS if n != "not"], _BREACHES, 5), before(["future", "potential", "any", "if", "should", "may", "might", "could", "would"], _BREACHES, 4)
#: What a sentence on covenants speaks of.
COVENANT_TOPIC = f"(?i){words(COVENANT)}|{phrase(['non compliance', 'noncompliance', 'in compliance with', 'comply with', 'complied with', 'waived', 'waiver', 'waivers', 'forbearance'])}"
#: A comparison with what is asked for is compliance where the sentence names a contract.
COMPARED = near([*forms("exceed"), "above", "below", "within", "less than", "in excess of"], "required requirement requirements minimum maximum threshold".split(), 14)
CONTRACT = phrase([*COVENANT, "contractual requirement", "contractual requirements", "credit agreement", "credit facility"])
#: A modal anywhere before a breach makes it supposed, unless something is stated before it too.
BREACH_MODAL = before(MODALS[:4], _BREACHES, 30)
BREACH_STATED = before("was were is are has have had did received obtained occurred arose entered remained failed", _BREACHES, 30)
RESOLUTIONS = {
    "waived": phrase("waive waived waiver waivers waiving"),
    "amended": phrase("amend amended amendment amendments amending"),
    "cured": phrase("cure cured curing remedied remedy remediation"),
}

# Rating actions, outlooks and watches.
DOWN, UP = "lowered downgraded cut reduced".split(), "raised upgraded".split()
VERB = rf"(?i)\b({'|'.join([*DOWN, *UP])})\b"
OUTLOOKS = "stable|negative|positive|developing|evolving"
MOVED = phrase([*forms("revise change move"), "lowered", "raised", "set"])
OUTLOOK_TO = rf"(?i)\b(?:outlook|trend)s?\b(?:[^\w.;]+\w+){{0,12}}?[^\w.;]+to\s+({OUTLOOKS})\b"
OUTLOOK_FROM = rf"(?i)\bto\s+(?:{OUTLOOKS})\s+from\s+({OUTLOOKS})\b"
WATCH = rf"(?i)\b(?:credit\s?watch|watch)\s+(?:with\s+)?({OUTLOOKS})\b"
REVIEW = r"(?i)\breview\s+for\s+(?:an?\s+)?(?:possible\s+)?(downgrade|upgrade)\b"
AFFIRMED = phrase(forms("affirm confirm"))
SHORT_TERM = r"(?i)\bshort[\s-]term\b"

# Bond prose.
INSTRUMENTS = "bond bonds notes debenture debentures schuldschein schuldscheindarlehen instrument at1 hybrid".split()
INSTRUMENT = phrase(INSTRUMENTS)
#: Verbs of selling a bond and of taking it back, by lemma.
SELL, BACK = "issue place price launch complete raise", "call redeem repay exercise"
COMPLETED = phrase([*forms(SELL), "sold", "successfully", "issuance", "placement", "offering"])
NOT_CALLED = f"{near(['not'], forms(BACK), 4)}|{phrase(['non call'])}"
REDEEMED = f"{phrase([*forms('redeem repay'), 'redemption', 'repayment'])}|{near(['will', 'has', 'decided'], ['call', 'called'], 2)}"
TAPPED = f"{phrase([*forms('reopen'), 'tap', 'taps', 'tapped'])}|{near(forms('increase'), ['size', 'volume'], 2)}"
INTENT = f"{phrase(forms('plan intend consider mandate'))}|{near(MODALS[:4], forms(SELL), 1)}|{phrase(['subject to'], ['market'], ['conditions'])}"
LOAN, TOTAL = phrase("loan loans facility facilities"), phrase("total aggregate combined")
GREEN = phrase(["green"], "bond bonds notes loan")
SENIORITIES = {"AT1": ["additional tier 1", "at1"], "T2": ["tier 2", "t2"], "hybrid": ["hybrid"], "subordinated": ["subordinated"], "senior": ["senior"]}
COUPON_FIRST, COUPON_LAST = r"(?i)(\d+(?:\.\d+)?)\s?(?:%|percent|per\s+cent)\s+(?:fixed\s+|annual\s+)?(?:coupon|interest)", r"(?i)\b(?:coupon|interest|bears|carries|rate)\b[^\d.;]{0,40}(\d+(?:\.\d+)?)\s?(?:%|percent|per\s+cent)"
TENOR_WORDS = {"three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "twelve": 12, "fifteen": 15, "twenty": 20, "thirty": 30}
TENOR = rf"(?i)\b(\d{{1,2}}|{'|'.join(TENOR_WORDS)})[\s-]years?\b"
DUE_YEAR = r"(?i)\b(?:due|maturing|maturity)\b[^.;]{0,30}?\b(20\d\d)\b"
CURRENCIES = {"EUR": "EUR", "€": "EUR", "euro": "EUR", "euros": "EUR", "USD": "USD", "US$": "USD", "$": "USD", "dollars": "USD", "GBP": "GBP", "£": "GBP", "CHF": "CHF", "SEK": "SEK", "NOK": "NOK", "DKK": "DKK", "JPY": "JPY"}
UNITS = {"billion": 1e9, "bn": 1e9, "million": 1e6, "mn": 1e6, "m": 1e6}
FIGURE = r"\d+(?:[.,]\d+)*"
_SIGNS = "|".join(c.replace("$", r"\$") for c in sorted(CURRENCIES, key=len, reverse=True) if not c.islower())
_NAMES = "|".join(c for c in sorted(CURRENCIES, key=len, reverse=True) if c.isalpha())
_UNITS = "|".join(sorted(UNITS, key=len, reverse=True))
#: Sign, figure, unit; and figure, unit, name.
AMOUNT = rf"(?i)(?:{_SIGNS})\s?({FIGURE})(?:\s?({_UNITS})\b)?"
AMOUNT_NAMED = rf"(?i)({FIGURE})\s?({_UNITS})\s(?:US\s)?(?:{_NAMES})\b"

# What a title of results names, and what makes a half year one.
PERIODS = [f"{n} quarter" for n in ("first", "second", "third", "fourth")] + ["q1", "q2", "q3", "q4", "half year", "h1", "h2", "nine months", "9m", "full year", "fiscal year", "annual results", "results", "interim report", "trading update"]
HALVES = ["first half", "second half"]
RESULT_NOUNS = "result results profit profitability revenue revenues sales earnings order orders delivery deliveries ebit ebitda margin margins outlook guidance quarter interim report".split()
RESULTS_TITLE = phrase(PERIODS)
HALF_TITLE = f"{either(HALVES, [*RESULT_NOUNS, 'cash flow'], 30)}"
