"""REST sources: a response is flattened to rows with inferred columns.

Fetching is a function that is given the call; without a network, fixtures answer.  Responses are small (a page of an API), so
they are parsed on the driver; a table of stored responses is flattened by executors with `flatten_column`."""

from __future__ import annotations

import base64
import hmac
import json
import secrets
import time
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tokens import QuerySyntaxError
from ..operators.kv import parse_scan

#: Inferred type names and the Spark types behind them.
SPARK_TYPES = {"json": "string", "integer": "int", "bigint": "bigint", "double precision": "double", "boolean": "boolean", "text": "string"}


@dataclass
class Endpoint:
    url: str = ""
    method: str = "GET"
    body: str = "form"
    auth: dict[str, str] = field(default_factory=dict)
    result_key: str | None = None


def parse_call(text: str) -> dict:
    """`{'name': api, 'endpoint': e, 'query': {...} | 'query-raw': s, 'result-key': k}`; query and query-raw exclude each other."""
    try:
        q = json.loads(text)
    except json.JSONDecodeError:
        q = parse_scan(text.rstrip()[:-1] + ", 'op': 'scan', 'table': ''}")
    if "query" in q and "query-raw" in q:
        raise QuerySyntaxError("query and query-raw exclude each other")
    if "name" not in q or "endpoint" not in q:
        raise QuerySyntaxError("a call names an api and an endpoint")
    return q


def _escaped(text: str) -> str:
    return urllib.parse.quote(text, safe="-._~")


def oauth1_header(auth: dict[str, str], method: str, url: str, params: list[tuple[str, str]], nonce: str | None = None, stamp: int | None = None) -> str:
    """The Authorization header of OAuth 1.0 (RFC 5849) with HMAC-SHA1; params are those of the query and of a form body."""
    own = {"oauth_consumer_key": auth["consumer_key"], "oauth_nonce": nonce or secrets.token_hex(16), "oauth_signature_method": "HMAC-SHA1", "oauth_timestamp": str(stamp or int(time.time())), "oauth_version": "1.0"}
    if "access_token" in auth:
        own["oauth_token"] = auth["access_token"]
    base, _, tail = url.partition("?")
    signed = sorted((_escaped(k), _escaped(v)) for k, v in [*own.items(), *params, *urllib.parse.parse_qsl(tail, True)])
    text = "&".join([method, _escaped(base), _escaped("&".join(f"{k}={v}" for k, v in signed))])
    key = f"{_escaped(auth['consumer_secret'])}&{_escaped(auth.get('access_secret', ''))}"
    own["oauth_signature"] = base64.b64encode(hmac.new(key.encode(), text.encode(), "sha1").digest()).decode()
    return "OAuth " + ", ".join(f'{k}="{_escaped(v)}"' for k, v in sorted(own.items()))


def oauth2_token(auth: dict[str, str]) -> str:
    """A bearer token by the client credentials grant of OAuth 2.0 (RFC 6749)."""
    form = {"grant_type": "client_credentials"} | ({"scope": auth["scope"]} if "scope" in auth else {})
    who = base64.b64encode(f"{urllib.parse.quote_plus(auth['client_id'])}:{urllib.parse.quote_plus(auth['client_secret'])}".encode()).decode()
    request = urllib.request.Request(auth["token_url"], urllib.parse.urlencode(form).encode(), {"Authorization": f"Basic {who}", "Content-Type": "application/x-www-form-urlencoded"})
    with urllib.request.urlopen(request, timeout=60) as r:  # noqa: S310
        return json.loads(r.read())["access_token"]


def fetch(endpoint: Endpoint, query: dict | str | None) -> str:
    """The response of an endpoint; auth is none, basic (user, password), token, OAuth 1.0 (consumer_key, consumer_secret, and
    access_token, access_secret) or OAuth 2.0 (client_id, client_secret, token_url)."""
    text = query if isinstance(query, str) else urllib.parse.urlencode(query or {})
    headers = {}
    if "consumer_key" in endpoint.auth:
        form = endpoint.method != "POST" or endpoint.body == "form"
        headers["Authorization"] = oauth1_header(endpoint.auth, endpoint.method, endpoint.url, urllib.parse.parse_qsl(text, True) if form else [])
    elif "client_id" in endpoint.auth:
        headers["Authorization"] = f"Bearer {oauth2_token(endpoint.auth)}"
    elif "user" in endpoint.auth:
        headers["Authorization"] = "Basic " + base64.b64encode(f"{endpoint.auth['user']}:{endpoint.auth.get('password', '')}".encode()).decode()
    elif "token" in endpoint.auth:
        headers["Authorization"] = f"Bearer {endpoint.auth['token']}"
    url, data = endpoint.url, None
    if endpoint.method == "POST":
        data = (json.dumps(query or {}) if endpoint.body == "json" else text).encode()
        headers["Content-Type"] = "application/json" if endpoint.body == "json" else "application/x-www-form-urlencoded"
    elif text:
        url += ("&" if "?" in url else "?") + text
    with urllib.request.urlopen(urllib.request.Request(url, data, headers), timeout=60) as r:  # noqa: S310
        return r.read().decode()


def descend(value, key: str | None):
    """What a dotted key path reaches in a response."""
    for part in key.split(".") if key else []:
        if isinstance(value, list):
            value = value[int(part)]
        elif isinstance(value, dict) and part in value:
            value = value[part]
        else:
            raise KeyError(f"the response has no {part}")
    return value


def _kind(v) -> str | None:
    if v is None or isinstance(v, (dict, list)):
        return "json"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "integer" if -(2**31) <= v < 2**31 else "bigint"
    return "double precision" if isinstance(v, float) else "text"


def infer(rows: list[dict]) -> list[tuple[str, str, bool]]:
    """(column, type, nullable): types that differ become json; a null or a missing key makes a column nullable."""
    kinds: dict[str, str | None] = {}
    nulls: set[str] = set()
    for n, row in enumerate(rows):
        for k, v in row.items():
            if k not in kinds and n:
                nulls.add(k)
            if v is None:
                nulls.add(k)
                kinds.setdefault(k, None)
            elif kinds.get(k) is None:
                kinds[k] = _kind(v)
            elif kinds[k] != _kind(v):
                kinds[k] = "bigint" if {kinds[k], _kind(v)} == {"integer", "bigint"} else "json"
        nulls |= kinds.keys() - row.keys()
    return [(k, t or "json", k in nulls) for k, t in kinds.items()]


def to_rows(value) -> list[dict]:
    """Rows of a response: objects as they are, arrays as col0, col1, ..., single values as col1."""
    items = value if isinstance(value, list) else [value]
    return [x if isinstance(x, dict) else {f"col{i}": y for i, y in enumerate(x)} if isinstance(x, list) else {"col1": x} for x in items]


def flatten(spark: SparkSession, text: str, key: str | None = None) -> DataFrame:
    rows = to_rows(descend(json.loads(text), key))
    columns = infer(rows)
    if not columns:
        return spark.createDataFrame([], "col1 string")

    def cell(v, t):
        if v is None:
            return None
        return json.dumps(v) if t == "json" else float(v) if t == "double precision" else v

    schema = ", ".join(f"`{c}` {SPARK_TYPES[t]}" for c, t, _ in columns)
    return spark.createDataFrame([tuple(cell(r.get(c), t) for c, t, _ in columns) for r in rows], schema)


def flatten_column(df: DataFrame, column: str, schema: str, key: str | None = None) -> DataFrame:
    """Rows of responses that a table holds as text, with named columns; executors parse them."""
    path = "$" + "".join(f".{p}" for p in key.split(".")) if key else "$"
    part = F.get_json_object(F.col(column), path)
    array = F.when(part.startswith("["), part).otherwise(F.concat(F.lit("["), part, F.lit("]")))
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.explode(F.from_json(array, f"array<struct<{schema}>>")).alias("_r")).select(*keep, "_r.*")


class ApiRegistry:
    def __init__(self):
        self.endpoints: dict[tuple[str, str], Endpoint] = {}
        self.fetch: Callable[[Endpoint, dict | str | None], str] = fetch
        self.fixtures: dict[tuple[str, str], str] = {}

    def add(self, name: str, endpoint: str, at: Endpoint | None = None, fixture: str | None = None) -> None:
        self.endpoints[name.lower(), endpoint.lower()] = at or Endpoint()
        if fixture is not None:
            self.fixtures[name.lower(), endpoint.lower()] = fixture

    def call(self, spark: SparkSession, text: str) -> DataFrame:
        q = parse_call(text)
        at = (q["name"].lower(), q["endpoint"].lower())
        if at not in self.endpoints:
            raise KeyError(f"no endpoint {q['endpoint']} of {q['name']}")
        got = self.fixtures[at] if at in self.fixtures else self.fetch(self.endpoints[at], q.get("query", q.get("query-raw")))
        return flatten(spark, got, q.get("result-key", self.endpoints[at].result_key))
