"""Profiles of people on networks: where to ask, and what an answer says, by one table of paths over VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.forms import bound
from skein.functions.text import classify_link

#: Where networks answer for a handle.
ADDRESSES = {"github": "https://api.github.com/users/{}", "gitlab": "https://gitlab.com/api/v4/users?username={}", "codeberg": "https://codeberg.org/api/v1/users/{}"}
#: The paths of an answer's name, text and picture, and its links as (network, path, address, whether only a handle is taken of it).
SHAPES = {
    "github": ("$.name", "$.bio", "$.avatar_url", [("website", "$.blog", "", False), ("email", "$.email", "mailto:", False), ("twitter", "$.twitter_username", "https://x.com/", False)]),
    "gitlab": ("$.name", "$.bio", "$.avatar_url", [("website", "$.website_url", "", False), ("email", "$.public_email", "mailto:", False), ("twitter", "$.twitter", "https://x.com/", True), ("linkedin", "$.linkedin", "https://www.linkedin.com/in/", True)]),
    "codeberg": ("$.full_name", "$.description", "$.avatar_url", [("website", "$.website", "", False), ("email", "$.email", "mailto:", False)]),
}
LINK = "struct<network:string,url:string,source:string,verified:boolean,confidence:double>"
#: How sure a link is that a person gives, that an instance has proved, that it has not, and the account itself.
GIVEN, PROVED, CLAIMED, ACCOUNT = 0.8, 0.95, 0.5, 0.6


def component(text: Column) -> Column:
    """A text as a part of an address."""
    out = F.url_encode(text)
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def profile_request(network: Column, handle: Column, token: str | None = None) -> Column:
    """(network, url, headers) of the request for an account; null where a network does not answer or the handle is none."""
    name = F.regexp_replace(F.coalesce(handle, F.lit("")), "^[@~]", "")
    parts = F.split(F.regexp_replace(name, "^@", ""), "@")
    there = F.when((F.size(parts) == 2) & (parts[0] != "") & (parts[1] != ""), F.concat(F.lit("https://"), parts[1], F.lit("/api/v1/accounts/lookup?acct="), component(parts[0])))
    url = F.when(network == "fediverse", there)
    for known, address in ADDRESSES.items():
        before, after = address.split("{}")
        url = url.when(network == known, F.concat(F.lit(before), component(name), F.lit(after)))
    plain, github = {"accept": "application/json"}, {"accept": "application/vnd.github+json"} | ({"authorization": f"Bearer {token}"} if token else {})
    headers = lambda of: F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
    return F.when((name != "") & url.isNotNull(), F.struct(network.alias("network"), url.alias("url"), F.when(network == "github", headers(github)).otherwise(headers(plain)).alias("headers")))


def _text(body: Column, path: str) -> Column:
    return F.trim(F.coalesce(F.try_variant_get(body, path, "string"), F.lit("")))


def _link(network: Column, url: Column, source: Column, verified: Column, confidence: Column) -> Column:
    return F.struct(network.alias("network"), url.alias("url"), source.alias("source"), verified.alias("verified"), confidence.alias("confidence"))


def _given(body: Column, of: str, links: list[tuple[str, str, str, bool]]) -> Column:
    """The links that a person gives, with a scheme where they have none."""

    def link(network: str, path: str, before: str, handle: bool) -> Column:
        value = _text(body, path)
        if handle:
            value = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "^@", ""), "(?i)^https?://[^/]+/(?:in/)?", ""), "/+$", "")
        whole = F.concat(F.lit(before), value)
        url = F.when(whole.rlike("(?i)^[a-z][a-z0-9+.-]*:"), whole).otherwise(F.concat(F.lit("https://"), whole))
        return F.when(_text(body, path) != "", _link(F.lit(network), url, F.lit(f"{of}-profile"), F.lit(False), F.lit(GIVEN)))

    return F.array_compact(F.array(*[link(*x) for x in links]))


def _shown(html: Column) -> Column:
    """Text of simple markup."""
    t = F.regexp_replace(F.regexp_replace(html, r"(?i)</(?:p|div|li|h[1-6])>|<br\s*/?>", " "), "<[^>]*>", "")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39|apos", "'"), ("amp", "&")):
        t = F.regexp_replace(t, f"(?i)&(?:{name});", char)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def _fediverse(body: Column) -> Column:
    none, source = F.lit(None).cast("string"), F.lit("fediverse-profile")

    def field(f: Column) -> Column:
        value = F.coalesce(F.try_variant_get(f, "$.value", "string"), F.lit(""))
        href = F.nullif(F.regexp_extract(value, 'href="([^"]+)"', 1), F.lit(""))
        proved = F.coalesce(F.try_variant_get(f, "$.verified_at", "string"), F.lit("")) != ""
        return _link(none, F.trim(F.regexp_replace(F.coalesce(href, value), "<[^>]*>", "")), source, proved, F.when(proved, PROVED).otherwise(CLAIMED))

    fields = F.coalesce(F.try_variant_get(body, "$.fields", "array<variant>"), F.array().cast("array<variant>"))
    links = F.filter(F.transform(fields, field), lambda x: x["url"] != "")
    own = F.coalesce(F.try_variant_get(body, "$.url", "string"), F.lit(""))
    account = F.when((own != ""), F.array(_link(none, own, source, F.lit(False), F.lit(ACCOUNT)))).otherwise(F.array().cast(f"array<{LINK}>"))
    return bound(links, lambda found: F.when(F.exists(found, lambda x: x["url"] == own), found).otherwise(F.concat(found, account)))


def identity_from_profile(network: Column, body: Column) -> Column:
    """(name, bio, avatar, kind, links) of a network's answer in JSON; empty and of unknown kind where network or answer are none.

    ``body`` is text; it is read as VARIANT, so fields that an answer lacks or has in another type are empty.
    """

    def row(name: Column, bio: Column, avatar: Column, kind: Column, links: Column) -> Column:
        return F.struct(name.alias("name"), bio.alias("bio"), avatar.alias("avatar"), kind.alias("kind"), links.cast(f"array<{LINK}>").alias("links"))

    def read(v: Column) -> Column:
        first = F.coalesce(F.try_variant_get(v, "$[0]", "variant"), v)
        kinds = {
            "github": F.coalesce(F.when(_text(v, "$.type") == "Organization", "org").when(_text(v, "$.type") == "User", "user"), F.lit("unknown")),
            "gitlab": F.lit("user"),
            "codeberg": F.when(F.try_variant_get(v, "$.user_type", "double") == 1, "org").otherwise("user"),
        }
        nothing = row(F.lit(""), F.lit(""), F.lit(""), F.lit("unknown"), F.array())
        shaped = lambda x: F.schema_of_variant(x).rlike("^(?:OBJECT|ARRAY)")
        picture = F.coalesce(F.nullif(_text(v, "$.avatar_static"), F.lit("")), _text(v, "$.avatar"))
        group = F.coalesce(F.try_variant_get(v, "$.group", "boolean"), F.lit(False))
        out = F.when(v.isNull() | ~shaped(v), nothing)
        out = out.when(network == "fediverse", row(_text(v, "$.display_name"), _shown(_text(v, "$.note")), picture, F.when(group, "org").otherwise("user"), _fediverse(v)))
        for name, (called, bio, avatar, links) in SHAPES.items():
            at = first if name == "gitlab" else v
            held = row(_text(at, called), _text(at, bio), _text(at, avatar), kinds[name], _given(at, name, links))
            out = out.when((network == name) & (F.lit(name != "gitlab") | F.schema_of_variant(at).startswith("OBJECT")), held)
        return out.otherwise(nothing)

    return bound(F.try_parse_json(body), read)


def links_from_search(network: Column, body: Column) -> Column:
    """Profiles (network, handle, url) of one network among a search's results in JSON, each address once, the first first; none is proved."""
    results = F.coalesce(F.try_variant_get(F.try_parse_json(body), "$.organic_results", "array<variant>"), F.array().cast("array<variant>"))
    links = F.filter(F.transform(results, lambda r: classify_link(F.try_variant_get(r, "$.link", "string"))), lambda x: x.isNotNull() & (x["network"] == network))
    return bound(links, lambda found: F.filter(found, lambda x, i: F.array_position(found["url"], x["url"]) == i + 1))
