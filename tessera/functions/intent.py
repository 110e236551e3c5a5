"""What a question asks for, by vocabulary: metric, direction, shape, grouping, measure family, entity."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

# Vocabularies: fixed values.
HIGH = "most top best highest largest biggest greatest max maximum".split()
LOW = "least lowest fewest smallest bottom worst min minimum".split()
MONEY = "revenue sales turnover income earnings spend spent billed".split()
COUNT = r"\b(?:how many|number of|count of)\b"
PRICE = "price prices priced cost costs expensive cheap cheapest pricey".split()
QUANTITY = "bought sold purchased quantity quantities units popular ordered".split()
GROUPING = "per each every".split()
RANKING = r"\b(?:top|first|latest|last|best|worst|most|least|highest|lowest|largest|smallest|biggest|longest|shortest|fewest|greatest|cheapest|maximum|minimum|bottom)\b"
ROWS = r"\b\d+\s+(?:rows?|records?|results?|entries|items|examples)\b"
LIST = r"^\s*(?:list|show|give|display|which|name|find|get|return)\b"
AGGREGATE = r"\b(?:how many|how much|total|sum|average|avg|mean|count|number of|maximum|minimum)\b"
ACTIVITY = r"\b(?:made|placed|bought|ordered|purchased|did|have|has|submitted|created)\b"
FAMILY_PARTS = {
    "price": {"price", "cost", "retailprice", "unitprice", "rate"},
    "quantity": {"quantity", "qty", "units", "count", "volume"},
    "money": {"total", "amount", "revenue", "price", "totalprice", "extendedprice", "balance", "acctbal", "sales", "value"},
}


def stem(word: str) -> str:
    for end, to in (("ies", "y"), ("sses", "ss"), ("xes", "x"), ("ches", "ch"), ("shes", "sh")):
        if word.endswith(end) and len(word) > len(end) + 1:
            return word[: -len(end)] + to
    return word[:-1] if word.endswith("s") and not word.endswith("ss") and len(word) > 3 else word


def _any(words: list[str], question: str) -> bool:
    return re.search(rf"\b(?:{'|'.join(words)})\b", question, re.I) is not None


def direction(question: str, claim: str | None = None) -> str | None:
    """I4: DESC or ASC by the question's superlatives; the claim where it has none or both."""
    high, low = _any(HIGH, question), _any(LOW, question)
    return claim if high == low else "DESC" if high else "ASC"


def asks_money(question: str) -> bool:
    """A word for money, or a total that is not one of rows."""
    low = re.findall(r"\w+", question.lower())
    return any(w in MONEY or (w == "total" and after not in ("number", "count")) for w, after in zip(low, [*low[1:], ""], strict=True))


def asks_count(question: str) -> bool:
    return re.search(COUNT, question, re.I) is not None


def asks_ranking(question: str) -> bool:
    return re.search(RANKING, question, re.I) is not None


def asks_rows(question: str) -> bool:
    """A number of rows, or a superlative."""
    return asks_ranking(question) or re.search(ROWS, question, re.I) is not None


def extreme(question: str) -> str | None:
    """MAX for the most expensive, MIN for the cheapest."""
    if re.search(r"\bmost expensive\b|\bpriciest\b|\bcostliest\b|\btop[- ]priced\b|\bhighest[- ](?:price|cost)", question, re.I):
        return "MAX"
    return "MIN" if re.search(r"\bcheapest\b|\bleast expensive\b|\blowest[- ](?:price|cost)", question, re.I) else None


def segments(name: str) -> set[str]:
    """Parts of a column name by case and underscores: never substrings."""
    return {x.lower() for x in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)}


def measure_family(question: str) -> str | None:
    """Price before quantity before money."""
    if _any(PRICE, question):
        return "price"
    if _any(QUANTITY, question):
        return "quantity"
    return "money" if asks_money(question) else None


def in_family(column: str, kind: str) -> bool:
    return bool(segments(column) & FAMILY_PARTS[kind])


def result_shape(question: str) -> str | None:
    """I8: ``list``, ``scalar`` or unknown."""
    wants = re.search(AGGREGATE, question, re.I) is not None
    if re.search(LIST, question, re.I) and not wants:
        return "list"
    return "scalar" if wants and not grouping(question) else None


def grouping(question: str) -> list[str]:
    """What follows "per", "each" or "every", and the one word after a "by" that closes a clause."""
    out = []
    for clause in re.split(r"[?.,;!]", question.lower()):
        low = re.findall(r"\w+", clause)
        out += [stem(b) for a, b in zip(low, low[1:], strict=False) if a in GROUPING]
        if low[-2:-1] == ["by"]:
            out.append(stem(low[-1]))
    return list(dict.fromkeys(out))


def has_activity(question: str) -> bool:
    return re.search(ACTIVITY, question, re.I) is not None


def says_none(question: str) -> bool:
    """Whether rows without something are asked for."""
    return re.search(r"\b(?:no|without|never|not any|none)\b", question, re.I) is not None


def says_sold(question: str) -> bool:
    return re.search(r"\b(?:sold|sales)\b", question, re.I) is not None


def lexemes(table: str) -> set[str]:
    """Singular and plural of a table's name and its parts."""
    parts = {table.lower(), *table.lower().split("_")}
    return parts | {stem(p) for p in parts} | {stem(p) + "s" for p in parts}


def corroborated(entity: str, question: str | None) -> bool:
    return question is None or bool(lexemes(entity) & set(re.findall(r"[a-z_]+", question.lower())))


def number(question: str) -> int | None:
    m = re.search(r"\b(?:top|first|last|bottom|best|worst|which|the)\s+(\d+)\b|\b(\d+)\s+\w+\s+(?:with|have|has)\b", question, re.I)
    return int(m[1] or m[2]) if m else None


@dataclass(frozen=True)
class Intent:
    """What the planner says; None is unknown and not checked."""

    tables: tuple[str, ...] = ()
    metric: str | None = None
    column: str | None = None
    entity: str | None = None
    ranked: bool | None = None
    direction: str | None = None
    limit: int | None = None
    soft: bool = False
    grouping: tuple[str, ...] = ()
    shape: str | None = None
    inferred: str | None = None


def gated(plan: Intent, question: str) -> Intent:
    """Claims that the question's words don't bear out are taken back or made soft."""
    from dataclasses import replace

    metric = plan.metric
    if metric and metric != "NONE" and not (asks_money(question) or asks_count(question) or extreme(question) == metric or re.search(AGGREGATE, question, re.I)):
        plan = replace(plan, metric=None, inferred=metric)
    if plan.ranked and not asks_ranking(question):
        plan = replace(plan, ranked=False, limit=None)
    if plan.ranked:
        return replace(plan, direction=direction(question, plan.direction))
    if plan.ranked is None and plan.metric in ("SUM", "COUNT", "AVG") and plan.grouping:
        return replace(plan, soft=True, direction="DESC")
    return plan


def extract_json(text: str) -> dict:
    """The first JSON object in an answer, thinking and fences left aside."""
    text = re.sub(r"<think(?:ing)?>.*?(?:</think(?:ing)?>|\Z)", "", text, flags=re.S | re.I)
    for i, c in enumerate(text):
        if c == "{":
            try:
                return json.JSONDecoder().raw_decode(text[i:])[0]
            except ValueError:
                continue
    return {}


def extract_sql(text: str) -> str:
    """The fenced block, else the longest stretch that starts with SELECT or WITH."""
    text = re.sub(r"<think(?:ing)?>.*?(?:</think(?:ing)?>|\Z)", "", text, flags=re.S | re.I)
    fenced = re.findall(r"```(?:sql)?\s*(.*?)```", text, re.S | re.I)
    found = [x for x in fenced if re.match(r"\s*(?:select|with)\b", x, re.I)] or re.findall(r"\b(?:select|with)\b.*?(?:;|\Z)", text, re.S | re.I)
    return top_to_limit(max(found, key=len).strip().rstrip(";").strip()) if found else ""


def top_to_limit(sql: str) -> str:
    """``SELECT TOP n ...`` as LIMIT n, which Spark's parser accepts."""
    m = re.match(r"\s*select\s+top\s*\(?\s*(\d+)\s*\)?\s+", sql, re.I)
    return f"SELECT {sql[m.end() :].rstrip().rstrip(';')} LIMIT {m[1]}" if m else sql
