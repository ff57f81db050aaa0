"""Truth from logs: occurrences, routes, resources, revisions, captures and payload chains."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspan.functions import text as T
from driftspan.operators.scans import Running, running
from driftspan.sources.io import checkpointed


def explode_parts(messages: DataFrame) -> DataFrame:
    """(world, message, part, part_type, text) of messages with parts array<struct<type, text, args,
    texts>>: text and reasoning as they are, a call's arguments, a result's texts by line; media,
    opaque and unknown parts have no text and go."""
    p = messages.select("world", "message", F.posexplode("parts").alias("part", "p"))
    text = F.when(F.col("p.type").isin("text", "reasoning"), F.col("p.text")).when(F.col("p.type") == "tool_call", F.col("p.args")).when(F.col("p.type").isin("tool_result", "server_tool_result"), F.array_join("p.texts", "\n"))
    return p.select("world", "message", "part", F.col("p.type").alias("part_type"), text.alias("text")).filter("text is not null")


def provider_parts(raw: DataFrame) -> DataFrame:
    """(id, part, type, text, name) of recorded provider responses (id, body), told apart by shape."""
    blocks = "content array<struct<type: string, text: string, thinking: string, name: string, input: string>>"
    a = raw.select("id", F.from_json("body", f"struct<{blocks}>").alias("b")).filter("b.content is not null")
    a = a.select("id", F.posexplode("b.content").alias("part", "c")).select("id", "part", F.when(F.col("c.type") == "tool_use", "tool_call").when(F.col("c.type") == "thinking", "reasoning").otherwise(F.col("c.type")).alias("type"), F.coalesce("c.text", "c.thinking", "c.input").alias("text"), F.col("c.name").alias("name"))
    o = raw.select("id", F.from_json("body", "struct<choices: array<struct<message: struct<content: string, tool_calls: array<struct<function: struct<name: string, arguments: string>>>>>>>").alias("b")).filter("b.choices is not null")
    o = o.select("id", F.col("b.choices")[0]["message"].alias("m"))
    text = F.array(F.struct(F.lit("text").alias("type"), F.col("m.content").alias("text"), F.lit(None).cast("string").alias("name")))
    calls = F.transform(F.coalesce("m.tool_calls", F.expr("cast(array() as array<struct<function: struct<name: string, arguments: string>>>)")), lambda c: F.struct(F.lit("tool_call").alias("type"), c["function"]["arguments"].alias("text"), c["function"]["name"].alias("name")))
    o = o.select("id", F.posexplode(F.filter(F.concat(text, calls), lambda x: x["text"].isNotNull())).alias("part", "c")).select("id", "part", "c.type", "c.text", "c.name")
    g = raw.select("id", F.from_json("body", "struct<candidates: array<struct<content: struct<parts: array<struct<text: string, functionCall: struct<name: string, args: string>>>>>>>").alias("b")).filter("b.candidates is not null")
    g = g.select("id", F.posexplode(F.col("b.candidates")[0]["content"]["parts"]).alias("part", "c")).select("id", "part", F.when(F.col("c.functionCall").isNotNull(), "tool_call").otherwise("text").alias("type"), F.coalesce("c.text", "c.functionCall.args").alias("text"), F.col("c.functionCall.name").alias("name"))
    return a.unionByName(o).unionByName(g)


#: First path segments of github.com that name no owner, and of gitlab.com that name no namespace.
NOT_OWNERS = (
    "about", "apps", "collections", "contact", "customer-stories", "enterprise", "events", "explore", "features", "issues", "login",
    "marketplace", "new", "notifications", "orgs", "pricing", "pulls", "search", "settings", "sponsors", "topics", "users",
)
NOT_NAMESPACES = ("-", "api", "dashboard", "explore", "groups", "help", "users", "search")

_HUB = rf"^github\.com/(?!(?:{'|'.join(NOT_OWNERS)})(?:/|$))([^/]+)/([^/]+?)(?:\.git)?"
_HUB_API = r"^api\.github\.com/repos/([^/]+)/([^/]+)"
_LAB = rf"^gitlab\.com/(?!(?:{'|'.join(NOT_NAMESPACES)})(?:/|$))((?:[^/]+/)+?[^/]+?)(?:\.git)?"
_LAB_API = r"^gitlab\.com/api/v4/projects/([^/]+%2F[^/]+)"

#: Sites where one thing has several URLs: pattern of host and path, kind, key in lower case, rest of the key as
#: written. The first that fits counts. Issues and pull requests of the one forge share their numbers.
SITES = (
    (_HUB + r"/(?:blob|raw)/[^/]+/(.+)$", "repo_file", "file:github.com/$1/$2", "/$3"),
    (_HUB + r"/(?:issues|pull)/([0-9]+)(?:/.*)?$", "thread", "thread:github.com/$1/$2/$3", ""),
    (_HUB + r"/(issues|pulls)$", "collection", "list:github.com/$1/$2/$3", ""),
    (_HUB + r"(?:/tree/[^/]+)?$", "repository", "repo:github.com/$1/$2", ""),
    (r"^codeload\.github\.com/([^/]+)/([^/]+)(?:/.*)?$", "repository", "repo:github.com/$1/$2", ""),
    (r"^raw\.githubusercontent\.com/([^/]+)/([^/]+)/(?:refs/(?:heads|tags)/)?[^/]+/(.+)$", "repo_file", "file:github.com/$1/$2", "/$3"),
    (_HUB_API + r"/contents/(.+)$", "repo_file", "file:github.com/$1/$2", "/$3"),
    (_HUB_API + r"/(?:issues|pulls)/([0-9]+)(?:/.*)?$", "thread", "thread:github.com/$1/$2/$3", ""),
    (_HUB_API + r"/(issues|pulls)$", "collection", "list:github.com/$1/$2/$3", ""),
    (_HUB_API + r"(?:/.*)?$", "repository", "repo:github.com/$1/$2", ""),
    (r"^([^./]+)\.github\.io/([^/]+)(?:/.*)?$", "repository", "repo:github.com/$1/$2", ""),
    (r"^([^./]+)\.github\.io/?$", "repository", "repo:github.com/$1/$1.github.io", ""),
    (_LAB + r"/-/(?:blob|raw)/[^/]+/(.+)$", "repo_file", "file:gitlab.com/$1", "/$2"),
    (_LAB + r"/-/(issues|merge_requests)/([0-9]+)(?:/.*)?$", "thread", "thread:gitlab.com/$1/$2/$3", ""),
    (_LAB + r"/-/(issues|merge_requests)$", "collection", "list:gitlab.com/$1/$2", ""),
    (_LAB + r"(?:/-(?:/(?!(?:issues|merge_requests|blob|raw)/).*)?)?$", "repository", "repo:gitlab.com/$1", ""),
    (_LAB_API + r"/repository/files/([^/]+)(?:/raw)?$", "repo_file", "file:gitlab.com/$1", "/$2"),
    (_LAB_API + r"/(issues|merge_requests)/([0-9]+)(?:/.*)?$", "thread", "thread:gitlab.com/$1/$2/$3", ""),
    (_LAB_API + r"/(issues|merge_requests)$", "collection", "list:gitlab.com/$1/$2", ""),
    (_LAB_API + r"(?:/.*)?$", "repository", "repo:gitlab.com/$1", ""),
    (r"^(?![^./]*-[0-9a-fA-F]{6}\.)([^./]+)\.gitlab\.io/([^/]+)(?:/.*)?$", "repository", "repo:gitlab.com/$1/$2", ""),
)

#: Wikis by the end of their host. Articles are under /wiki/, scripts under /w/ or / (PLAIN_WIKI); titles
#: begin with a capital letter but for SMALL_WIKI; the mobile host is the same site but for PLAIN_WIKI.
WIKIS = ("wikipedia.org", "wikimedia.org", "wikibooks.org", "wikiquote.org", "wikisource.org", "wikiversity.org", "wikivoyage.org", "wikinews.org", "wikidata.org", "mediawiki.org", "wiktionary.org", "fandom.com")
SMALL_WIKI, PLAIN_WIKI = "wiktionary.org", "fandom.com"
_WIKI_HOST = rf"(?:^|\.)(?:{'|'.join(w.replace('.', '[.]') for w in WIKIS)})$"


def normal_percent(text: Column) -> Column:
    """text with escapes of letters, digits, - . _ ~ undone, other escapes in upper case, and what a
    URL cannot hold as it is (spaces, characters beyond ASCII) escaped."""
    units = F.regexp_extract_all(text, F.lit(r"(%[0-9A-Fa-f]{2}|[^\x21-\x7E]+|[^%\x00-\x20\x7F-\x{10FFFF}]+|%)"), F.lit(1))
    plain = r"^%(?:2[dDeE]|3[0-9]|4[1-9a-fA-F]|5[0-9aAfF]|6[1-9a-fA-F]|7[0-9aAeE])$"

    def unit(u: Column) -> Column:
        code = F.conv(F.substring(u, 2, 2), 16, 10).cast("int")
        return F.when(u.rlike(plain), F.char(code)).when(u.rlike(r"^%[0-9A-Fa-f]{2}$"), F.upper(u)).when(u.rlike(r"^[\x21-\x7E]"), u).otherwise(F.replace(F.url_encode(u), F.lit("+"), F.lit("%20")))

    return F.when(text.rlike(r"[^\x21-\x24\x26-\x7E]"), F.array_join(F.transform(units, unit), "")).otherwise(text)


def percent_decoded(text: Column) -> Column:
    """text with its escapes undone, or as it is where they give no text."""
    out = F.try_url_decode(F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))
    return F.when(~text.contains("%"), text).otherwise(T.let(out, lambda o: F.when(o.isNull() | o.contains("�"), text).otherwise(o)))


def wiki_page(host: Column, path: Column, query: Column) -> Column:
    """The article URL without scheme of a request to one of WIKIS, else null.

    A title is the same with underscores or spaces, with or without a section, by its article, its
    REST or script address or its API calls; of an API call that names several the first counts.
    """
    value = lambda name: F.nullif(F.try_url_decode(F.regexp_extract(query, rf"(?:^|&){name}=([^&]*)", 1)), F.lit(""))
    plain = host.endswith(PLAIN_WIKI)
    script = F.when(plain, F.regexp_extract(path, r"^/(index|api)\.php$", 1)).otherwise(F.regexp_extract(path, r"^/w/(index|api)\.php$", 1))
    rest = F.when(plain, F.regexp_extract(path, r"^/rest\.php/v1/page/([^/]+)", 1)).otherwise(F.regexp_extract(path, r"^/w/rest\.php/v1/page/([^/]+)", 1))
    named = F.concat(F.regexp_extract(path, "^/wiki/(.+)$", 1), F.regexp_extract(path, "^/api/rest_v1/page/[^/]+/([^/]+)", 1), rest)  # one of them at most
    titles = F.get(F.filter(F.split(value("titles"), r"\|"), lambda t: t.rlike(r"[^\s_]")), 0)
    called = T.let(value("action"), lambda action: F.when(action.isin("edit", "delete", "protect", "undelete"), value("title")).when(action == "move", value("from")).when(action == "query", titles).when(action == "parse", value("page")))
    raw = F.when(named != "", percent_decoded(named)).when(script == "index", value("title")).when(script == "api", called)
    title = F.trim(F.regexp_replace(F.regexp_replace(raw, "(?s)#.*$", ""), r"[_\s]+", " "))

    def article(t: Column) -> Column:
        out = F.when(host.endswith(SMALL_WIKI), t).otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30)))
        for char, code in (("%", "%25"), ("?", "%3F"), ("\\", "%5C"), (" ", "_")):
            out = F.replace(out, F.lit(char), F.lit(code))
        site = F.when(plain, host).otherwise(F.regexp_replace(host, r"^([^.]+)\.m\.(?=.)", "$1."))
        return F.when(t != "", F.concat(site, F.lit("/wiki/"), T.let(out, normal_percent)))

    return F.when(host.rlike(_WIKI_HOST), T.let(title, article))


def canonical_resource(url: Column) -> Column:
    """Struct (key, kind) of a URL, git remote or absolute path: what names one thing has one key.

    Scheme, user, default port, fragment, www. and m. go; the host is in lower case; `.` and `..`
    are walked; percent escapes are in one form; the query is sorted without tracking parameters.
    Null has a null key and kind.
    Pages of WIKIS have the URL of their article; SITES give repository, file, thread and
    collection keys.
    """
    remote = F.regexp_replace(F.trim(url), r"^(?:ssh://)?git@([^:/]+)[:/](.*)$", "https://$1/$2")

    def cut(remote: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(remote, "(?s)#.*$", ""), r"^(?i:https?)://(?:[^/?@]*@)?", "")
        is_url = remote.rlike(r"^(?i:https?)://")
        host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"\.?(?::(?:80|443))?$", "")
        host = F.regexp_replace(host, r"^(?:www|m)\.", "")
        path = F.when(is_url, normal_percent(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1))).otherwise(remote)
        walked = F.aggregate(F.filter(F.split(path, "/"), lambda s: (s != "") & (s != ".")), F.expr("cast(array() as array<string>)"), lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
        return F.struct(remote.alias("remote"), is_url.alias("is_url"), host.alias("host"), F.concat(F.lit("/"), F.array_join(walked, "/")).alias("path"), F.regexp_extract(bare, r"(?s)\?(.*)$", 1).alias("query"))

    def named(x: Column) -> Column:
        params = F.array_sort(F.transform(F.filter(F.split(x["query"], "&"), lambda p: (p != "") & ~p.rlike(r"^(?:utm_[^=]*|ref|fbclid|gclid)(?:=|$)")), normal_percent))
        ending = T.let(params, lambda q: F.when(F.size(q) > 0, F.concat(F.lit("?"), F.array_join(q, "&"))).otherwise(""))
        of = lambda key, kind: F.struct(key.alias("key"), F.lit(kind).alias("kind"))
        plain = of(F.concat(F.lit("url:"), F.coalesce(wiki_page(x["host"], x["path"], x["query"]), F.concat(x["host"], F.when(x["path"] == "/", "").otherwise(x["path"]), ending))), "url")
        place = F.concat(x["host"], x["path"])
        fits = reduce(lambda out, i: out.when(place.rlike(SITES[i][0]), i), range(1, len(SITES)), F.when(place.rlike(SITES[0][0]), 0))
        rules = F.expr("array(" + ", ".join("named_struct('pattern', r'{}', 'kind', '{}', 'low', '{}', 'rest', '{}')".format(*rule) for rule in SITES) + ")")
        key = lambda r: percent_decoded(F.concat(F.lower(F.regexp_replace(place, r["pattern"], r["low"])), F.regexp_replace(place, r["pattern"], r["rest"])))
        site = T.let(F.get(rules, fits), lambda r: F.when(r.isNotNull(), F.struct(key(r).alias("key"), r["kind"].alias("kind"))))
        other = F.when(x["remote"].startswith("/"), of(F.concat(F.lit("file:"), x["path"]), "file")).otherwise(of(F.concat(F.lit("opaque:"), x["remote"]), "opaque"))
        forge = x["host"].rlike(r"(?:^|\.)(?:github|gitlab|githubusercontent)\.(?:com|io)$")
        return F.when(x["remote"].isNull(), of(F.lit(None).cast("string"), None)).when(~x["is_url"], other).otherwise(F.coalesce(F.when(forge, site), plain))

    return T.let(T.let(remote, cut), named)


#: Names of arguments whose value is a path.
PATH_KEYS = ("path", "file", "file_path", "filepath", "filename", "target", "source_path", "target_path")


def call_resource(args: Column) -> Column:
    """The first argument of a call, by name, that is a URL, or an absolute path under a name of PATH_KEYS."""
    entries = F.array_sort(F.map_entries(F.from_json(args, "map<string,string>")))
    fit = F.filter(entries, lambda e: e["value"].rlike(r"^(?i:https?)://[^\s/?#][^\s]*$") | (e["value"].startswith("/") & e["key"].isin(*PATH_KEYS)))
    return F.get(fit, 0)["value"]


def match_need(response: Column, read: Column) -> Column:
    """The weakest class that finds what was read (the needle) in the response that wrote it.

    exact: as it is; decoded: as a JSON string literal's content; normalized: folded; decoded: folded
    after one level of escapes is undone on either side; two_string_levels (out of reach): after two
    on one side; decoded: where only undoing every level helps; else semantic. Blanks at the end of
    what was read do not count once folded, and blank reads are exact or semantic.
    """

    def kind(x: Column) -> Column:
        text, needle = x["text"], x["needle"]
        some = lambda c: c != ""
        ended = lambda c: F.rtrim(T.fold_plain(c))

        def once(f: Column) -> Column:
            # texts without a backslash say the same at every level
            plain, undone, folded, needle_once = f["plain"], f["undone"], f["folded"], f["needle_once"]
            one_level = (some(needle_once) & (plain.contains(needle_once) | undone.contains(needle_once))) | undone.contains(folded)
            twice = lambda c: T.let(T.unescape_once(c), lambda u: T.unescape_once(u))
            two_levels = (needle.contains("\\") & T.let(ended(twice(needle)), lambda n: some(n) & plain.contains(n))) | (text.contains("\\") & T.fold_plain(twice(text)).contains(folded))
            deep = T.let(T.fold(needle), lambda n: (F.trim(n) != "") & T.fold(text).contains(n))
            return F.when(folded == "", "semantic").when(plain.contains(folded), "normalized").when(one_level, "decoded").when(two_levels, "two_string_levels").when(deep, "decoded").otherwise("semantic")

        literal = T.let(T.json_unescape(needle), lambda v: (v != needle) & v.rlike(f"[^{T.SPACE}]") & text.contains(v))
        forms = F.struct(T.fold_plain(text).alias("plain"), T.fold_plain(T.unescape_once(text)).alias("undone"), ended(needle).alias("folded"), ended(T.unescape_once(needle)).alias("needle_once"))
        return F.when(text.contains(needle), "exact").when(literal, "decoded").otherwise(T.let(forms, once))

    found = T.let(F.struct(response.alias("text"), read.alias("needle")), kind)
    return F.when(response.isNull() | read.isNull(), "semantic").otherwise(found)


def hit_routes(hits: DataFrame, calls: DataFrame) -> DataFrame:
    """hits (hit, world, exchange, role, call_id) with carrier, route_kind and resource: system and
    user text is direct; a tool result goes by the last call with its id in the request (world,
    exchange, call_id, pos, tool, args): its resource is a channel, without one it is direct."""
    last = calls.groupBy("world", "exchange", "call_id").agg(F.max_by(F.struct("tool", "args"), "pos").alias("call"))
    rows = hits.join(last, ["world", "exchange", "call_id"], "left")
    resource = F.when(F.col("role") == "tool", canonical_resource(call_resource(F.col("call.args")))["key"])
    return rows.select("hit", "world", "exchange", F.when(F.col("role") == "tool", "tool_result").otherwise(F.col("role")).alias("carrier"), F.when(resource.isNotNull(), "channel").otherwise("direct").alias("route_kind"), resource.alias("resource"), F.col("call.tool").alias("tool"))


#: Windows at blanks have at least this many characters.
SHORTEST = 8
#: Where needles' windows begin with so few characters, texts' windows that begin with others are not made.
FIRSTS = 16


def _blank_windows(text: Column, k: int, begins: dict[str, str] | None = None) -> dict[str, Column]:
    """By kind, an array of (kind, w) of a folded text: up to k characters, and SHORTEST at least,
    after each blank (a), before each, reversed (b), and from each place inside a word (c).

    begins: by kind, the pattern of the first character; kinds without one are left out."""
    texts = {"a": (text, "(?<= )(?=(%s.{%d,%d}))"), "b": (F.reverse(text), "(?<= )(?=(%s.{%d,%d}))"), "c": (text, "(?=(%s[^ ]{%d,%d}))")}
    begins = {"a": ".", "b": ".", "c": "[^ ]"} if begins is None else begins
    found = lambda t, pattern, kind: F.transform(F.regexp_extract_all(t, F.lit(pattern % (begins[kind], SHORTEST - 1, k - 1)), F.lit(1)), lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("w")))
    return {kind: found(t, pattern, kind) for kind, (t, pattern) in texts.items() if kind in begins}


def _meetings(needles: DataFrame, texts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, needle_id, text_id), each once: texts that hold the rarest window of a folded needle.

    needles with keys, needle_id, plain; texts with keys, text_id, w (a row per form). Where a
    needle's blank is followed by characters enough, a copy's is followed by the same, so that only
    windows at blanks are looked at, and not those at every place: after a blank, before one where
    that is longer, or inside a word for needles of one word. A window that begins as none of the
    needles' goes at once; the others meet needles' windows of each length. Texts are read once, the
    needles' windows in them counted, and each needle then takes the texts of its rarest, so that
    needles with a beginning in common do not meet each other's texts. A needle with a window that
    no text has meets none. What is too short around its blanks is looked for as one window of its
    own length, of which there are fewer than 2 * SHORTEST.
    """
    kinds = _blank_windows(F.col("plain"), k)
    longest = lambda ws: F.coalesce(F.array_max(F.transform(ws, lambda x: F.length(x["w"]))), F.lit(0))
    n = needles.select(*keys, "needle_id", "plain", *[ws.alias(kind) for kind, ws in kinds.items()])
    n = n.withColumns({f"n_{kind}": longest(F.col(kind)) for kind in kinds})
    c = F.when(~F.col("plain").contains(" "), F.col("c"))
    best = F.when(F.greatest("n_a", "n_b") >= SHORTEST, F.when((F.col("n_a") >= k) | (F.col("n_a") >= F.col("n_b")), F.col("a")).otherwise(F.col("b"))).otherwise(c)
    n = checkpointed(n.select(*keys, "needle_id", "plain", best.alias("best")))
    anchors = n.select(*keys, "needle_id", F.explode(F.filter("best", lambda x: F.length(x["w"]) == longest(F.col("best")))).alias("x")).select(*keys, "needle_id", "x.kind", "x.w").distinct()
    found = anchors.groupBy("kind").agg(F.collect_set(F.length("w")).alias("sizes"), F.slice(F.collect_set(F.substring("w", 1, 1)), 1, FIRSTS + 1).alias("firsts")).collect()
    rest = n.filter("best is null or size(best) = 0").select(*keys, "needle_id", "plain")
    sizes = sorted(r["size"] for r in rest.select(F.least(F.length("plain"), F.lit(k)).alias("size")).distinct().collect())
    if sizes:
        texts = checkpointed(texts)  # read by each pass
    met = None
    if found:
        begin = lambda c: F.xxhash64("kind", F.substring(c, 1, SHORTEST))
        begins = {r["kind"]: "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(r["firsts"])) + "]" if len(r["firsts"]) <= FIRSTS else "[^ ]" if r["kind"] == "c" else "." for r in found}
        rows = texts.select(*keys, "text_id", F.inline(F.concat(*_blank_windows(F.col("w"), k, begins).values())))
        rows = rows.withColumn("b", begin(F.col("w"))).join(anchors.select(*keys, begin(F.col("w")).alias("b")).distinct(), [*keys, "b"], "left_semi")
        lengths = F.array(*[F.lit(size) for size in sorted({size for r in found for size in r["sizes"]})])
        cut = F.transform(F.filter(lengths, lambda x: x <= F.length("w")), lambda x: F.xxhash64("kind", F.substring(F.col("w"), F.lit(1), x)))
        a = anchors.select(*keys, "needle_id", F.xxhash64("kind", "w").alias("h"))
        hits = rows.select(*keys, "text_id", F.explode(cut).alias("h")).join(a.select(*keys, "h").distinct(), [*keys, "h"], "left_semi").distinct()
        hits = checkpointed(hits)
        counted = a.join(hits.groupBy(*keys, "h").agg(F.count("*").alias("n")), [*keys, "h"], "left").groupBy(*keys, "needle_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h")).alias("r"))
        met = hits.join(counted.filter("r.n > 0").select(*keys, "needle_id", "r.h"), [*keys, "h"]).select(*keys, "needle_id", "text_id")
    for size in sizes:
        windows = T.shingles(texts, "w", size)
        own = T.shingles(rest.filter(F.least(F.length("plain"), F.lit(k)) == size), "plain", size).filter("off = 0").drop("off")
        one = windows.join(own, [*keys, "h"]).select(*keys, "needle_id", "text_id")
        met = one if met is None else met.union(one)
    if met is None:
        met = texts.join(needles.select(*keys, "needle_id"), F.lit(False)).select(*[texts[x] for x in keys], "needle_id", "text_id")
    return met.distinct()


#: Needles that one row holds beside its text.
HELD = 256


def find_occurrences(needles: DataFrame, texts: DataFrame, keys: list[str] | None = None, k: int = T.K) -> DataFrame:
    """(keys, needle_id, text_id, copy, class, start, stop): every copy of a needle in a text of equal
    keys, with its raw range [start, stop), numbered from 0 in order.

    needles: keys, needle_id, needle; texts: keys, text_id, text. Copies are looked for as they are
    (exact), folded (normalized), and folded once one level of string escapes is undone
    (decoded:json_string or decoded:yaml_string, by the copy's escapes), in this order; one that
    overlaps an earlier kind's is left out. Blanks around a needle do not count, and blank or null
    needles and null texts give nothing. Ids are unique among equal keys.
    """
    keys = keys or []
    one = [*keys, "text_id"]
    wanted = F.regexp_replace("needle", f"^[{T.SPACE}]+|[{T.SPACE}]+$", "")
    n = needles.select(*keys, "needle_id", wanted.alias("needle")).filter("needle <> ''").withColumn("plain", F.rtrim(T.fold_plain(F.col("needle"))))
    # dealt out by id: a small file of long texts would be one task
    t = texts.select(*keys, "text_id", "text").filter("text is not null").repartition(*one)
    undone = lambda: F.when(F.col("text").contains("\\"), T.unescape_once(F.col("text")))
    forms = F.array(T.fold_plain(F.col("text")), T.fold_plain(undone()))
    met = checkpointed(_meetings(n, t.select(*one, F.explode(F.array_compact(forms)).alias("w")), keys, k))
    # a text is moved, folded and mapped once for the needles it meets, and only where it has copies
    met = met.withColumn("deal", F.floor((F.row_number().over(Window.partitionBy(*one).orderBy("needle_id")) - 1) / HELD))
    held = met.join(n, [*keys, "needle_id"]).groupBy(*one, "deal").agg(F.collect_list(F.struct("needle_id", "needle", "plain")).alias("held"))
    rows = t.join(held.hint("merge"), one).select(*one, "text", "held", undone().alias("undone")).select("*", T.fold_plain(F.col("text")).alias("w0"), T.fold_plain(F.col("undone")).alias("w1"))
    rows = rows.select(*one, "text", "undone", "w0", "w1", F.filter("held", lambda x: F.col("w0").contains(x["plain"]) | F.coalesce(F.col("w1").contains(x["plain"]), F.lit(False))).alias("held"))

    def copies(rank: int, at: Column, length: Column, start, stop) -> Column:
        return F.transform(at, lambda p: F.struct(F.lit(rank).alias("rank"), start(p).alias("start"), stop(p + length - 1).alias("stop")))

    def mapped(rank: int, ready: Column, levels: int, quick: Column) -> Column:
        """Struct (quick, f): f, the map of all characters, only where it is needed."""
        some = F.exists("held", lambda x: ready.contains(x["plain"]))
        return F.struct(quick.alias("quick"), F.when(some & ~quick, T.fold_mapped(F.col("text"), levels)).alias("f")).alias(f"f{rank}")

    level = T.keeps_places
    rows = rows.select(*one, "text", "w0", "w1", "held", mapped(1, F.col("w0"), 0, level(F.col("text"), F.col("w0"))), mapped(2, F.col("w1"), 1, F.coalesce(T.simply_escaped(F.col("text")) & level(F.col("undone"), F.col("w1")), F.lit(False))), T.in_blocks(T.escape_places(F.col("text"))).alias("escapes"))

    def found(x: Column) -> Column:
        length, none = F.length(x["plain"]), F.expr("array()").cast("array<struct<rank: int, start: int, stop: int>>")
        exact = copies(0, T.places(F.col("text"), x["needle"]), F.length(x["needle"]), lambda p: p, lambda q: q + 1)
        by_map = lambda rank: copies(rank, T.places(F.col(f"f{rank}.f.folded"), x["plain"]), length, lambda p: F.get(F.col(f"f{rank}.f.starts"), p), lambda q: F.get(F.col(f"f{rank}.f.ends"), q))
        folded = F.when(F.col("f1.quick"), copies(1, T.places(F.col("w0"), x["plain"]), length, lambda p: p, lambda q: q + 1)).otherwise(F.coalesce(by_map(1), none))
        before = lambda p: T.count_below(F.col("escapes"), p)
        escaped = F.when(F.col("w1").isNull(), none).when(F.col("f2.quick"), copies(2, T.places(F.col("w1"), x["plain"]), length, lambda p: p + before(p), lambda q: q + 1 + before(q + 1))).otherwise(F.coalesce(by_map(2), none))
        return F.transform(F.concat(exact, folded, escaped), lambda c: F.struct(x["needle_id"].alias("needle_id"), c["rank"].alias("rank"), c["start"].alias("start"), c["stop"].alias("stop"), F.when(c["rank"] == 2, T.string_codec(F.substring(F.col("text"), c["start"] + 1, c["stop"] - c["start"]))).alias("codec")))

    rows = rows.select(*one, F.inline(F.flatten(F.transform("held", found))))
    by = [*one, "needle_id"]
    for rank in (1, 2):  # what overlaps a copy of an earlier kind goes
        taken = F.col("rank") < rank
        reached = F.max(F.when(taken, F.col("stop"))).over(Window.partitionBy(*by).orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1))
        ahead = F.min(F.when(taken, F.col("start"))).over(Window.partitionBy(*by).orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumns({"reached": reached, "ahead": ahead})
        clear = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("ahead", "stop") >= F.col("stop"))
        rows = rows.filter((F.col("rank") != rank) | clear).drop("reached", "ahead")
    kind = F.when(F.col("rank") == 0, "exact").when(F.col("rank") == 1, "normalized").otherwise(F.concat(F.lit("decoded:"), "codec"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("start")) - 1
    return rows.select(*keys, "needle_id", "text_id", place.alias("copy"), kind.alias("class"), "start", "stop")


def first_later_call(outputs: DataFrame, calls: DataFrame) -> DataFrame:
    """outputs (run, text_id, pos) with exchange: the run's first call after pos, of several there the
    smallest exchange; outputs that no call follows go. calls: run, pos, exchange."""
    rows = outputs.select("run", "pos", F.lit(1).alias("k"), "text_id", F.lit(None).cast(calls.schema["exchange"].dataType).alias("exchange"))
    rows = rows.unionByName(calls.select("run", "pos", F.lit(0).alias("k"), "exchange"), allowMissingColumns=True)
    rows = running(rows, ["run"], ["pos", "k", "exchange"], {"next": Running("last", F.col("exchange"))}, backward=True)
    return rows.filter("k = 1 and next is not null").select("run", "text_id", "pos", F.col("next").alias("exchange"))


def injection_labels(needles: DataFrame, outputs: DataFrame, calls: DataFrame) -> DataFrame:
    """(run, needle_id, text_id, copy, start, stop, reader_exchange, need, tier): each copy of an
    injection in a tool output that the run's model went on to read.

    needles: run, needle_id, needle; outputs: run, text_id, pos, text, resource; calls: run, pos,
    exchange. Needles of one text are one, the smallest id. What comes by a resource arrived where the
    attacker never wrote: unobserved and out of reach; other copies need their class.
    """
    once = needles.groupBy("run", F.regexp_replace("needle", f"^[{T.SPACE}]+|[{T.SPACE}]+$", "").alias("needle")).agg(F.min("needle_id").alias("needle_id"))
    read = checkpointed(first_later_call(outputs, calls).join(outputs.select("run", "text_id", "resource"), ["run", "text_id"]))
    held = find_occurrences(once, outputs.join(read.select("run", "text_id"), ["run", "text_id"], "left_semi"), ["run"])
    far = F.col("resource").isNotNull()
    rows = held.join(read.drop("pos"), ["run", "text_id"])
    return rows.select("run", "needle_id", "text_id", "copy", "start", "stop", F.col("exchange").alias("reader_exchange"), F.when(far, "unobserved").otherwise(F.col("class")).alias("need"), F.when(far, "out_of_reach").otherwise("construction").alias("tier"))


def _replayable(revisions: DataFrame) -> DataFrame:
    """revisions with prev (the page's last seq before, null where the revision is its own source
    throughout), hunks in order, and problem: base_range or unbalanced where hunks do not fit."""
    by = Window.partitionBy("page").orderBy("seq")
    rows = revisions.select("page", "seq", "n_lines", F.array_sort("hunks").alias("hunks"), F.lag("seq").over(by).alias("prev"), F.lag("n_lines").over(by).alias("base"))
    ends = F.transform("hunks", lambda h: h["at"] + h["removed"])
    apart = F.forall(F.sequence(F.lit(0), F.size("hunks") - 1), lambda i: F.get("hunks", i)["at"] >= F.when(i > 0, F.get(ends, i - 1)).otherwise(0))
    inside = F.forall("hunks", lambda h: (h["removed"] >= 0) & (h["added"] >= 0)) & (F.array_max(ends) <= F.col("base"))
    total = F.col("base") + F.aggregate("hunks", F.lit(0).cast("long"), lambda acc, h: acc + h["added"] - h["removed"])
    some = F.col("prev").isNotNull() & (F.coalesce(F.size("hunks"), F.lit(0)) > 0)
    problem = F.when(some, F.when(~(apart & inside), "base_range").when(total != F.col("n_lines"), "unbalanced"))
    rows = rows.withColumn("problem", problem)
    return rows.withColumn("prev", F.when(some & F.col("problem").isNull(), F.col("prev")))


def unreplayable(revisions: DataFrame) -> DataFrame:
    """(page, seq, problem): revisions whose hunks overlap or leave their base (base_range), or do not
    give their number of lines (unbalanced); line_sources takes them as their own source."""
    return _replayable(revisions).filter("problem is not null").select("page", "seq", "problem")


def line_sources(revisions: DataFrame) -> DataFrame:
    """(page, seq, first_line, lines, source): for each revision the longest runs of lines that one
    revision wrote, in order.

    revisions: page, seq, n_lines, hunks array<struct<at, removed, added>> by lines of the previous
    revision, in any order. A page's first revision, one without hunks and one whose hunks cannot
    be replayed are their own source throughout.

    A revision is a map of runs of its lines to runs of the one before. Maps are composed with the
    map of the revision they point to, so that pointers reach twice as far back each round: a page
    of n revisions takes log n rounds, each a join on page and revision, and no task holds a page.
    """
    rows = checkpointed(_replayable(revisions))
    own = rows.filter("prev is null").select("page", "seq", F.lit(0).alias("lo"), F.col("n_lines").alias("hi"), F.col("seq").alias("src"), F.lit(0).alias("src_lo"), F.lit(True).alias("done"))
    end = F.array(F.struct(F.col("base").alias("at"), F.lit(0).alias("removed"), F.lit(0).alias("added")))
    hunk = "array<struct<at: bigint, removed: bigint, added: bigint>>"
    cut = rows.filter("prev is not null").select("page", "seq", "prev", F.posexplode(F.concat(F.col("hunks").cast(hunk), end.cast(hunk))).alias("i", "h")).select("page", "seq", "prev", "i", "h.*")
    by = Window.partitionBy("page", "seq").orderBy("i")
    cut = cut.withColumn("start", F.coalesce(F.lag(F.col("at") + F.col("removed")).over(by), F.lit(0))).withColumn("shift", F.coalesce(F.sum(F.col("added") - F.col("removed")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = F.struct((F.col("start") + F.col("shift")).alias("lo"), (F.col("at") + F.col("shift")).alias("hi"), F.col("prev").alias("src"), F.col("start").alias("src_lo"), F.lit(False).alias("done"))
    new = F.struct((F.col("at") + F.col("shift")).alias("lo"), (F.col("at") + F.col("shift") + F.col("added")).alias("hi"), F.col("seq").alias("src"), F.lit(0).cast("long").alias("src_lo"), F.lit(True).alias("done"))
    kinds = "page, seq, cast(lo as bigint) lo, cast(hi as bigint) hi, cast(src as bigint) src, cast(src_lo as bigint) src_lo, done"
    runs = own.selectExpr(*kinds.split(", ")).union(cut.select("page", "seq", F.inline(F.array(kept, new))).selectExpr(*kinds.split(", "))).filter("lo < hi")
    runs = checkpointed(runs)
    while not runs.filter("not done").isEmpty():
        far = runs.select("page", F.col("seq").alias("src"), F.col("lo").alias("t_lo"), F.col("hi").alias("t_hi"), F.col("src").alias("t_src"), F.col("src_lo").alias("t_from"), F.col("done").alias("t_done"))
        met = runs.filter("not done").drop("done").join(far, ["page", "src"]).withColumn("s", F.greatest("src_lo", "t_lo")).withColumn("e", F.least(F.col("src_lo") + F.col("hi") - F.col("lo"), "t_hi")).filter("s < e")
        moved = met.selectExpr("page", "seq", "lo + s - src_lo as lo", "lo + e - src_lo as hi", "t_src as src", "t_from + s - t_lo as src_lo", "t_done as done")
        runs = checkpointed(runs.filter("done").union(moved))
    order = Window.partitionBy("page", "seq").orderBy("lo")
    islands = runs.withColumn("new", F.when(F.lag("src").over(order) == F.col("src"), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    return islands.groupBy("page", "seq", "run", F.col("src").alias("source")).agg(F.min("lo").alias("first_line"), F.sum(F.col("hi") - F.col("lo")).alias("lines")).select("page", "seq", "first_line", "lines", "source")


def page_reads(revisions: DataFrame, sources: DataFrame) -> DataFrame:
    """(page, reader, seq, source_author, first_line, lines, kind): an edit by another author than
    the last one's reads the previous revision; runs of lines of one author who is not the reader
    are transmissions the first time the reader has that source of the page, else rereads.

    revisions: page, seq, author; sources: line_sources(...).
    """
    by = Window.partitionBy("page").orderBy("seq")
    reads = revisions.withColumn("last", F.lag("author").over(by)).withColumn("prev", F.lag("seq").over(by)).filter("last is not null and last <> author")
    runs = reads.select("page", "prev", F.col("author").alias("reader"), "seq").join(sources.withColumnRenamed("seq", "prev"), ["page", "prev"])
    runs = runs.join(revisions.select("page", F.col("seq").alias("source"), F.col("author").alias("source_author")), ["page", "source"]).filter("source_author <> reader")
    first = F.min("seq").over(Window.partitionBy("page", "reader", "source"))
    return runs.withColumn("kind", F.when(F.col("seq") == first, "transmission").otherwise("reread")).select("page", "reader", "seq", "source_author", "first_line", "lines", "kind")


def relay_lines(lines: DataFrame) -> DataFrame:
    """(page, seq, line, author, origin): lines an author inserted that an earlier author of the page
    wrote. lines: page, seq, line_no, author, text of inserted lines. Short lines are left out."""
    good = lines.filter(F.length("text") >= T.K)
    first = good.groupBy("page", "text").agg(F.min(F.struct("seq", "line_no", "author")).alias("f"))
    met = good.join(first, ["page", "text"]).filter("f.seq < seq and f.author <> author")
    return met.select("page", "seq", F.col("line_no").alias("line"), "author", F.col("f.author").alias("origin"))


def second_hop(injections: DataFrame, benign: DataFrame, calls: DataFrame) -> DataFrame:
    """(run, call, indicator): an attacker's indicator that no benign prompt of the run has, in a later
    call. injections: run, at, text; benign: run, text; calls: run, call, at, args."""
    bad = T.indicators(injections.select("run", F.col("at").alias("seen"), "text"), "text")
    bad = bad.join(T.indicators(benign.select("run", "text"), "text"), ["run", "indicator"], "left_anti")
    return calls.join(bad, "run").filter("at > seen").filter(F.lower("args").contains(F.col("indicator"))).select("run", "call", "indicator").distinct()


def truth_to_capture(truth: DataFrame, results: DataFrame, writers: DataFrame) -> DataFrame:
    """truth (id, session, tool_use_id, sha256) with exchange, message, writer_exchange and status.

    results: session, exchange, at, tool_use_id, pos, message, body; writers: session, tool_use_id,
    exchange, at. The first exchange of the session whose request has the result counts, in it the
    last such result, whose body must have the digest; the writer is the first response with the
    call. status: kept, or dropped:no_result, dropped:digest, noted:no_writer.
    """
    first = results.groupBy("session", "tool_use_id").agg(F.min(F.struct("at", "exchange")).alias("f"))
    last = results.join(first, ["session", "tool_use_id"]).filter("exchange = f.exchange").groupBy("session", "tool_use_id").agg(F.max_by(F.struct("exchange", "message", "body"), "pos").alias("r"))
    wrote = writers.groupBy("session", "tool_use_id").agg(F.min(F.struct("at", "exchange"))["exchange"].alias("writer_exchange"))
    rows = truth.join(last, ["session", "tool_use_id"], "left").join(wrote, ["session", "tool_use_id"], "left")
    status = F.when(F.col("r").isNull(), "dropped:no_result").when(F.sha2(F.col("r.body"), 256) != F.col("sha256"), "dropped:digest").when(F.col("writer_exchange").isNull(), "noted:no_writer").otherwise("kept")
    return rows.select("id", "session", F.col("r.exchange").alias("exchange"), F.col("r.message").alias("message"), "writer_exchange", status.alias("status"))


def _peeled(now: Column) -> Column:
    """Struct (layer, text): the outermost layer of an encoded token and what it holds; null where none fits."""

    def escaped() -> Column:
        return F.when(now.startswith("\\x") & now.rlike(r"^(?:\\x[0-9a-fA-F]{2}){2,}+$"), T.decode_hex(F.replace(now, F.lit("\\x"), F.lit(""))))

    def url() -> Column:
        broken = lambda text: text.contains("\ufffd") & ~F.upper(now).contains("%EF%BF%BD")  # bytes that are no UTF-8
        return F.when(now.contains("%") & ~now.rlike(r'[\s"]'), T.let(T.decode_url(now), lambda text: F.when(~broken(text), text)))

    hexed = F.when(now.rlike("^[0-9a-fA-F]{16,}+$"), T.decode_hex(now))
    based = F.when(now.rlike("^[0-9A-Za-z+/=_-]{24,}+$") & ~now.rlike("^[0-9a-fA-F]*+$"), T.decode_base64(now))
    layer = lambda name, text: T.let(text, lambda t: F.when(t.isNotNull(), F.struct(F.lit(name).alias("layer"), t.alias("text"))))
    return F.coalesce(*[layer(name, text) for name, text in (("byte_escape", escaped()), ("url", url()), ("hex", hexed), ("base64", based))])  # no layer is tried after one that fits


def decode_chains(payloads: DataFrame, max_depth: int = 6) -> DataFrame:
    """(id, chain, decoded, depth, corroborated): candidates of payloads (id, parent, text) peeled
    layer by layer (byte_escape, url, hex, base64) until nothing fits; long and wordy enough ones
    stay, each text once per payload. corroborated: another payload has this one as its parent.

    Candidates are the strings in atob(...), and runs of base64, of hexadecimal, of anything but
    white space and quotes, and of \\x escapes, of 16 characters or more.
    """
    # each with what a text must hold for it to be looked for
    patterns = (("atob('", r"atob\('([^']*+)'", 1), ('atob("', r'atob\("([^"]*+)"', 1), ("", "[0-9A-Za-z+/=_-]{16,}+", 0), ("", "[0-9a-fA-F]{16,}+", 0), ("", r'[^\s"\x{80}-\x{10FFFF}]{16,}+', 0), ("\\x", r"(?:\\x[0-9a-fA-F]{2}){4,}+", 0))
    none = F.array().cast("array<string>")
    runs = F.array_distinct(F.concat(*[F.when(F.col("text").contains(held), F.regexp_extract_all("text", F.lit(p), F.lit(group))).when(F.col("text").isNotNull(), none) for held, p, group in patterns]))
    start = lambda token: F.struct(F.trim(token).alias("now"), F.expr("cast(array() as array<string>)").alias("chain"), F.lit(True).alias("open"))

    def peel(acc: Column, _: Column) -> Column:
        more = lambda x: F.when(x.isNotNull(), F.struct(F.trim(x["text"]).alias("now"), F.concat(acc["chain"], F.array(x["layer"])).alias("chain"), F.lit(True).alias("open"))).otherwise(F.struct(acc["now"].alias("now"), acc["chain"].alias("chain"), F.lit(False).alias("open")))
        return F.when(acc["open"], T.let(_peeled(acc["now"]), more)).otherwise(acc)

    # a filter on columns would be moved below them, and every candidate peeled again for each test
    ends = F.transform(F.filter(runs, lambda t: F.length(t) >= 16), lambda t: F.aggregate(F.sequence(F.lit(1), F.lit(max_depth)), start(t), peel))
    wordy = lambda t: (F.length(t) >= 24) & (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) >= 20)
    good = payloads.select("id", F.inline(F.filter(ends, lambda x: (F.size(x["chain"]) > 0) & wordy(x["now"]))))
    one = good.groupBy("id", "now").agg(F.min(F.array_join("chain", ".")).alias("chain"))
    parents = payloads.filter("parent is not null").select(F.col("parent").alias("id")).distinct().withColumn("corroborated", F.lit(True))
    return one.join(parents, "id", "left").select("id", "chain", F.col("now").alias("decoded"), F.size(F.split("chain", r"\.")).alias("depth"), F.coalesce("corroborated", F.lit(False)).alias("corroborated"))


def chain_tally(chains: DataFrame) -> DataFrame:
    """(chain, tokens, chars, corroborated) of decode_chains(...)."""
    return chains.groupBy("chain").agg(F.count("*").alias("tokens"), F.sum(F.length("decoded")).alias("chars"), F.count_if("corroborated").alias("corroborated"))


def arrival_tally(slots: DataFrame) -> DataFrame:
    """(suite, exact, normalized, decoded, absent, attacks, second_hops) from slots (suite, class or
    null, attack, second_hop)."""
    return slots.groupBy("suite").agg(*[F.count_if(F.col("class") == c).alias(c) for c in ("exact", "normalized", "decoded")], F.count_if(F.col("class").isNull()).alias("absent"), F.count_if("attack").alias("attacks"), F.count_if("second_hop").alias("second_hops"))


def delivery_labels(transcript: DataFrame, turns: DataFrame, calls: DataFrame, share: DataFrame) -> DataFrame:
    """(world, send_id, to_agent, reader_exchange, kind, tier): deliveries of a transcript.

    transcript: world, send_id, from_agent (null: none), to_agent, text, rejected, ord; turns: world,
    to_agent, text, ord, exchange; calls: world, send_id, exchange; share: world, send_id,
    forwarding. The n-th equal text to an agent is the n-th turn with it; a send without a sender
    is a control, a rejected one is dropped to rejected, one that was never read is unplaced.
    """
    x = transcript.withColumn("n", F.row_number().over(Window.partitionBy("world", "to_agent", "text").orderBy("ord")))
    y = turns.withColumn("n", F.row_number().over(Window.partitionBy("world", "to_agent", "text").orderBy("ord"))).select("world", "to_agent", "text", "n", F.col("exchange").alias("reader_exchange"))
    rows = x.join(y, ["world", "to_agent", "text", "n"], "left").join(calls.select("world", "send_id", F.col("exchange").alias("sender_exchange")), ["world", "send_id"], "left").join(share, ["world", "send_id"], "left")
    kind = F.when(F.col("rejected"), "rejected").when(F.col("reader_exchange").isNull(), "unplaced").when(F.col("from_agent").isNull(), "control").otherwise("transmission")
    tier = F.when(F.col("forwarding"), "forwarding").when(F.col("sender_exchange").isNull(), "likely").otherwise("certain")
    return rows.select("world", "send_id", "to_agent", "reader_exchange", kind.alias("kind"), F.when(kind == "transmission", tier).alias("tier"))


def shared_source_labels(turns: DataFrame) -> DataFrame:
    """(world, agent, pos, reason): texts that agents are fed from one source, once per reader: the
    first message and results of shared tools; turns of the harness are boilerplate.

    turns: world, agent, pos, role, source (prompt, shared_tool, harness or other), text.
    """
    fed = turns.filter(F.col("source").isin("prompt", "shared_tool", "harness"))
    first = F.row_number().over(Window.partitionBy("world", "agent", "source", "text").orderBy("pos"))
    rows = fed.withColumn("n", first).filter("n = 1 and (source <> 'prompt' or pos = 0)")
    return rows.select("world", "agent", "pos", F.when(F.col("source") == "harness", "boilerplate").otherwise("shared_source").alias("reason"))
