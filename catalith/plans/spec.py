"""The state of the faceted filter, from and to a url's query string."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import parse_qs, urlencode, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.operators.filters import at_most_version
from catalith.operators.ranking import SORT_MODES


@dataclass(frozen=True)
class FilterSpec:
    """Values that differ from the defaults are active."""

    q: str = ""
    license: str = ""
    msrv: str = ""
    sort: str = "default"
    deprecated: bool = True
    recommended: bool = False
    stack: str = ""

    @classmethod
    def from_url(cls, url: str, licenses: set[str] | None = None, msrvs: set[str] | None = None, stacks: set[str] | None = None) -> FilterSpec:
        """Read a url; values that are not on their option list (where one is given) are ignored."""
        args = {k: v[0] for k, v in parse_qs(urlsplit(url).query).items()}
        listed = lambda k, options: v if (v := args.get(k, "")) and (options is None or v in options) else ""
        sort = args.get("sort", "default")
        return cls(args.get("q", ""), listed("license", licenses), listed("msrv", msrvs), sort if sort in SORT_MODES else "default", args.get("deprecated") != "0", args.get("recommended") == "1", listed("stack", stacks))

    def to_query_string(self) -> str:
        """Only what differs from the defaults."""
        args = [("q", self.q.strip()), ("license", self.license), ("msrv", self.msrv), ("sort", "" if self.sort == "default" else self.sort), ("deprecated", "" if self.deprecated else "0"), ("recommended", "1" if self.recommended else ""), ("stack", self.stack)]
        return urlencode([(k, v) for k, v in args if v])

    def active_count(self) -> int:
        """Active filters; search text doesn't count, a sort order does."""
        return sum((bool(self.license), bool(self.msrv), self.sort != "default", not self.deprecated, self.recommended, bool(self.stack)))

    def predicates(self, hay: str = "haystack", licenses: str = "license_tokens", msrv: str = "msrv", archived: str = "archived", recommended: str = "recommended") -> list[Column | None]:
        """The active predicates; stacks are applied through their membership marks."""
        terms = self.q.lower().split()
        search = None
        for t in terms:
            one = F.contains(F.col(hay), F.lit(t))
            search = one if search is None else search & one
        return [
            search,
            None if self.deprecated else ~F.col(archived),
            F.col(recommended) if self.recommended else None,
            F.array_contains(licenses, self.license) if self.license else None,
            at_most_version(msrv, self.msrv) if self.msrv else None,
        ]


def states(df: DataFrame, url: str, licenses: set[str] | None = None, msrvs: set[str] | None = None, stacks: set[str] | None = None) -> DataFrame:
    """Adds the state's fields to rows with a url each; values that are not on their option list (where one is given) are ignored."""
    arg = lambda key: F.coalesce(F.try_url_decode(F.try_parse_url(F.col(url), F.lit("QUERY"), F.lit(key))), F.lit(""))
    listed = lambda key, options: arg(key) if options is None else F.when(arg(key).isin(*options), arg(key)).otherwise("")
    return df.withColumns(
        {
            "q": arg("q"),
            "license": listed("license", licenses),
            "msrv": listed("msrv", msrvs),
            "sort": F.when(arg("sort").isin(*SORT_MODES), arg("sort")).otherwise("default"),
            "deprecated": arg("deprecated") != "0",
            "recommended": arg("recommended") == "1",
            "stack": listed("stack", stacks),
        }
    )


def active_count() -> Column:
    """Active filters of a state's columns; search text doesn't count, a sort order does."""
    c = F.col
    active = (c("license") != "", c("msrv") != "", c("sort") != "default", ~c("deprecated"), c("recommended"), c("stack") != "")
    return sum((a.cast("int") for a in active), F.lit(0))


def query_string() -> Column:
    """A state's columns as a query string, only what differs from the defaults."""
    c = F.col
    given = [("q", F.btrim(c("q"))), ("license", c("license")), ("msrv", c("msrv")), ("sort", F.nullif(c("sort"), F.lit("default"))), ("deprecated", F.when(~c("deprecated"), "0")), ("recommended", F.when(c("recommended"), "1")), ("stack", c("stack"))]
    return F.concat_ws("&", *(F.when(v != "", F.concat(F.lit(f"{k}="), F.url_encode(v))) for k, v in given))
