"""Versions, reviews, conversations, usage, rules and settings as relational transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.sources.shared import shared_path

#: The formats; below, dollars per million tokens by model (cache hit, cache miss, output), doubled in peak hours.
FORMATS = ("docx", "markdown", "html", "pdf")
#: What stands for the result of a call that was broken off, and for a folded result (around its length and its first line).
INTERRUPTED = "（该工具调用被中断，未执行）"
FOLDED = ("[旧的工具输出已折叠以节省上下文（原 ", " 字，开头：", "）。如需其中内容，请重新调用相应工具读取。]")
#: The built-in commands.
COMMANDS = "help mode track author undo history rewind verify export convert think cost context compact clear todos skills agents memory remember doctor review".split()
MODES = "default acceptEdits plan bypassPermissions".split()
PRICES = {"flash": (0.003, 0.15, 0.6), "pro": (0.022, 0.66, 1.98)}


def _by_day(log: DataFrame, session: str, at: str, value: Column) -> DataFrame:
    """The log with its day and the sum of ``value`` over a session's earlier days; so a session of any length is summed by days, and only rows of one day meet in one task."""
    day = F.coalesce(F.to_date(at), F.lit("0001-01-01").cast("date"))
    dated = log.withColumn("__day", day)
    sums = dated.groupBy(session, "__day").agg(F.sum(value).alias("__s"))
    before = F.coalesce(F.sum("__s").over(Window.partitionBy(session).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dated.join(sums.select(session, "__day", before.alias("__before")), [session, "__day"])


def versions(log: DataFrame, session: str, at: str, tie: str) -> DataFrame:
    """An append-only log with version numbers by session."""
    n = F.row_number().over(Window.partitionBy(session, "__day").orderBy(at, tie))
    return _by_day(log, session, at, F.lit(1)).withColumn("v", (F.col("__before") + n).cast("int")).drop("__day", "__before")


def undone(versions_: DataFrame, session: str, value: str) -> DataFrame:
    """Each version with the value that undoing it returns to, NULL for the first."""
    earlier = versions_.select(session, (F.col("v") + 1).alias("v"), F.col(value).alias("undo_to"))
    return versions_.select(session, "v", value).join(earlier, [session, "v"], "left")


def running_totals(log: DataFrame, session: str, at: str, tie: str, value: str) -> DataFrame:
    """The running total of each session's values, as ``total``."""
    upto = F.sum(value).over(Window.partitionBy(session, "__day").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0))
    return _by_day(log, session, at, F.col(value)).withColumn("total", F.col("__before") + upto).drop("__day", "__before")


def latest(log: DataFrame, session: str, value: str, order: Column) -> DataFrame:
    """The newest version of each session; partial maxima are shuffled, not the log."""
    return log.groupBy(session).agg(F.count(F.lit(1)).alias("v"), F.max_by(value, order).alias(value))


def reviewed(revisions: DataFrame, accept: bool, author: str | None = None, refs: list[str] | None = None) -> DataFrame:
    """Each document's text after accepting or rejecting its revisions, or those of an author or with one of some ids: one side of insertions and deletions stays. Revisions that aren't
    reviewed stay as they stand, both sides shown."""
    mine = F.lit(True) if author is None else F.coalesce(F.col("author") == author, F.lit(False))
    mine &= F.lit(True) if refs is None else F.coalesce(F.col("rev_id").isin(refs), F.lit(False))
    keep = (F.col("kind") == "keep") | ~mine | ((F.col("kind") == "ins") == F.lit(accept))
    kept = F.array_sort(F.collect_list(F.when(keep, F.struct("ordinal", "text"))))
    return revisions.groupBy("doc_id").agg(F.array_join(F.transform(kept, lambda x: x["text"]), "").alias("text"))


def paired_messages(messages: DataFrame) -> DataFrame:
    """A history that an interface accepts: results of calls stay, orphans go, and calls without a result before the next message get a stand-in."""
    w = Window.partitionBy("session").orderBy("idx")
    turn = F.sum(F.when(F.col("role") != "tool", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    m = messages.withColumn("turn", turn)
    calls = m.filter("role = 'assistant' AND call_ids IS NOT NULL").select("session", "turn", F.posexplode(F.split("call_ids", ",")).alias("pos", "id"))
    results = m.filter("role = 'tool'").groupBy("session", "turn", F.col("tool_call_id").alias("id")).agg(F.min(F.struct("idx", "content")).alias("r"))
    got = calls.join(results, ["session", "turn", "id"], "left")
    tools = got.select("session", "turn", F.when(F.col("r").isNull(), 2).otherwise(1).alias("part"), F.coalesce(F.col("r.idx"), F.col("pos")).alias("at"), F.lit("tool").alias("role"), F.coalesce("r.content", F.lit(INTERRUPTED)).alias("content"), F.col("id").alias("tool_call_id"))
    others = m.filter("role <> 'tool'").select("session", "turn", F.lit(0).alias("part"), F.col("idx").alias("at"), "role", F.coalesce("content", F.lit("")).alias("content"), F.lit(None).cast("string").alias("tool_call_id"))
    order = Window.partitionBy("session").orderBy("turn", "part", "at")
    return others.unionByName(tools).select("session", F.row_number().over(order).alias("pos"), "role", "content", "tool_call_id")


def folded_results(history: DataFrame, keep: int = 6, least: int = 1500) -> DataFrame:
    """All but the newest ``keep`` tool results of a session, where long and not folded yet, become one line."""
    w = Window.partitionBy("session", F.col("role") == "tool").orderBy(F.col("idx").desc())
    old = (F.col("role") == "tool") & (F.row_number().over(w) > keep) & (F.length("content") >= least) & ~F.startswith("content", F.lit(FOLDED[0][:10]))
    first = F.left(F.split_part(F.col("content"), F.lit("\n"), F.lit(1)), F.lit(120))
    line = F.concat(F.lit(FOLDED[0]), F.length("content"), F.lit(FOLDED[1]), first, F.lit(FOLDED[2]))
    return history.select("session", "idx", "role", old.alias("folded"), F.when(old, line).otherwise(F.col("content")).alias("content"))


def usage_costs(usage: DataFrame) -> DataFrame:
    """Cost of each request (columns model, prompt, cached, completion, ts in UTC); twice as much from Monday to Friday, 1 to 4 and 6 to 10."""
    hour, day = F.hour("ts"), F.dayofweek("ts")
    peak = ~day.isin(1, 7) & (((hour >= 1) & (hour < 4)) | ((hour >= 6) & (hour < 10)))
    price = lambda i: F.when(F.contains("model", F.lit("pro")), PRICES["pro"][i]).otherwise(PRICES["flash"][i])
    cost = (F.col("cached") * price(0) + F.greatest(F.col("prompt") - F.col("cached"), F.lit(0)) * price(1) + F.col("completion") * price(2)) / 1e6
    return usage.withColumn("peak", peak).withColumn("cost", cost * F.when(peak, 2).otherwise(1))


def decisions(calls: DataFrame, rules: DataFrame, mode: str) -> DataFrame:
    """What may be done: deny and ask rules, the tool's own word, mode, read-only, plan, allow rules, accepted edits, else ask."""
    parts = r"^([A-Za-z0-9_]+)(?:\((.*)\))?$"
    name, body = F.regexp_extract("rule", parts, 1), F.regexp_extract("rule", parts, 2)
    glob = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(body, r"[.+?^${}()|\[\]\\]", r"\\$0"), r"\*", ".*"), F.lit("$"))
    known = rules.filter(F.col("rule").rlike(parts)).select("list", "idx", "rule", name.alias("name"), body.alias("body"), glob.alias("glob"), F.contains("rule", F.lit("(")).alias("narrow"))
    hit = calls.join(known, (F.col("name") == F.col("tool")) & (~F.col("narrow") | (F.col("body") == "*") | F.expr("content RLIKE glob")))
    first = hit.groupBy("call_id").agg(*[F.min_by(F.when(F.col("list") == x, F.col("rule")), F.when(F.col("list") == x, F.col("idx"))).alias(x) for x in ("deny", "ask", "allow")])
    c = calls.join(first, "call_id", "left")
    said = (
        F.when(F.col("deny").isNotNull(), "deny:rule").when(F.col("ask").isNotNull(), "ask:rule").when(F.col("own").isNotNull(), F.concat("own", F.lit(":tool")))
        .when(F.lit(mode == "bypassPermissions"), "allow:bypass").when(F.col("readonly"), "allow:readonly").when(F.lit(mode == "plan"), "deny:plan")
        .when(F.col("allow").isNotNull(), "allow:rule").when(F.lit(mode == "acceptEdits") & (F.col("category") == "edit") & ~F.col("destructive"), "allow:edits").otherwise("ask:default")
    )
    return c.select("call_id", F.lit(mode).alias("mode"), said.alias("decision"))


def layered(settings: DataFrame) -> DataFrame:
    """Scalars of the highest layer."""
    return settings.groupBy("key").agg(F.max_by("value", "prio").alias("value"), F.max_by("layer", "prio").alias("layer"))


def numbered_rules(rules: DataFrame, chunk: int = 1024) -> DataFrame:
    """Rules of all layers as one list, lower layers first: ordinal, layer, rule. Positions are numbered within chunks; chunks and the few layers are counted before, so no
    task sorts them all. Positions of a layer are whole numbers, its own each."""
    r = rules.withColumn("chunk", F.floor(F.col("pos") / chunk))
    counts = r.groupBy("prio", "chunk").agg(F.count(F.lit(1)).alias("n"))
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.withColumn("inner", upto(Window.partitionBy("prio").orderBy("chunk")))
    layers = counts.groupBy("prio").agg(F.sum("n").alias("n")).withColumn("outer", upto(Window.orderBy("prio"))).select("prio", "outer")
    starts = before.join(layers, "prio").select("prio", "chunk", (F.col("inner") + F.col("outer")).alias("start"))
    number = F.row_number().over(Window.partitionBy("prio", "chunk").orderBy("pos"))
    return r.withColumn("k", number).join(starts, ["prio", "chunk"]).select((F.col("start") + F.col("k")).cast("int").alias("ordinal"), "layer", "rule")


def first_wins(names: DataFrame) -> DataFrame:
    """Of equal names the one of the first source."""
    return names.groupBy("name").agg(F.min_by("source", F.struct("prio", "pos")).alias("source"))


def tool_pools(tools: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Tools that each format can use, and whether a sub-agent may; both tables are fixed dimensions of some dozens of rows."""
    can = tools.join(capabilities, F.col("needs") == F.col("capability")).select("format", "tool", "agent_ok")
    always = tools.filter("needs IS NULL").select(F.explode(F.array(*map(F.lit, FORMATS))).alias("format"), "tool", "agent_ok")
    return can.unionByName(always).select("format", "tool", (F.col("agent_ok") & (F.col("tool") != "agent")).alias("sub_agent"))


def style_usage(styles: DataFrame, paras: DataFrame) -> DataFrame:
    """How many paragraphs and runs use each style, most used first; a paragraph without one uses the default. Uses are counted before styles come in."""
    each = paras.select(F.explode(F.array(F.coalesce("style", F.lit("")), "run_style")).alias("style_id")).filter("style_id IS NOT NULL").groupBy("style_id").agg(F.count(F.lit(1)).alias("n"))
    default = styles.filter("is_default AND type = 'paragraph'").select(F.lit("").alias("style_id"), F.col("style_id").alias("d"))
    n = each.join(default, "style_id", "left").groupBy(F.when(F.col("style_id") == "", F.col("d")).otherwise(F.col("style_id")).alias("style_id")).agg(F.sum("n").alias("n"))
    return styles.join(n, "style_id", "left").select("style_id", "name", "type", F.coalesce("n", F.lit(0)).alias("in_use")).orderBy(F.col("in_use").desc(), "name")


def style_lists(usage: DataFrame, most: int = 40) -> DataFrame:
    """By type of style: the used ones with their counts, the number of unused ones and the first ``most`` of their names."""
    line = F.when(F.col("in_use") > 0, F.struct((-F.col("in_use")).alias("o"), "name", F.concat(F.col("name"), F.lit(" ｜ "), F.col("style_id"), F.lit(" ｜ "), F.col("in_use")).alias("s")))
    g = usage.groupBy("type").agg(F.array_sort(F.collect_list(line)).alias("u"), F.count_if(F.col("in_use") == 0).alias("unused"), F.array_sort(F.collect_list(F.when(F.col("in_use") == 0, F.col("name")))).alias("names"))
    shown = F.concat(F.array_join(F.slice("names", 1, most), "、"), F.when(F.col("unused") > most, F.lit("…")).otherwise(F.lit("")))
    return g.select("type", F.array_join(F.transform("u", lambda x: x["s"]), "\n").alias("used"), "unused", shown.alias("unused_names"))


def heading_levels(spark: SparkSession, styles: DataFrame) -> DataFrame:
    """The heading level of each style: the first outline level below 9 or, where the chain has none, the first heading-like name up the chain of parents, which ends where a style comes again.

    Each round doubles how far a style looks: what it found in its first 2**k ancestors is completed by what the one after them found. A chain of any depth takes as many rounds as
    its length has binary digits, and a row is held once a style, not once an ancestor. A cycle only repeats what was nearer, so it ends with the number of styles. Rounds are
    written to the shared folder. Of rows with one style_id, which documents don't have, the least parent and level serve.
    """
    name = F.lower("name")
    named = F.coalesce(F.nullif(F.regexp_extract(name, "^(?:heading |标题 ?)([1-9])", 1), F.lit("")), F.nullif(F.regexp_extract(name, "^h([1-9])", 1), F.lit(""))).cast("int")
    own = styles.filter("style_id IS NOT NULL").select("style_id", F.col("based_on").alias("at"), F.when(F.col("outline_lvl") < 9, F.col("outline_lvl") + 1).alias("lv"), named.alias("nm"))
    path = shared_path(spark, "heading-levels")
    own.groupBy("style_id").agg(*(F.min(c).alias(c) for c in ("at", "lv", "nm"))).write.parquet(f"{path}/0")
    seen, reach, k = spark.read.parquet(f"{path}/0"), 1, 0
    total = seen.count()
    while reach < total and seen.filter("lv IS NULL AND at IS NOT NULL").limit(1).count():
        up = seen.select(F.col("style_id").alias("at"), F.col("at").alias("up"), F.col("lv").alias("up_lv"), F.col("nm").alias("up_nm"))
        on = seen.filter("lv IS NULL AND at IS NOT NULL").join(up, "at", "left").select("style_id", F.col("up").alias("at"), F.col("up_lv").alias("lv"), F.coalesce("nm", "up_nm").alias("nm"))
        reach, k = 2 * reach, k + 1
        on.unionByName(seen.filter("lv IS NOT NULL OR at IS NULL")).write.parquet(f"{path}/{k}")
        seen = spark.read.parquet(f"{path}/{k}")
    return styles.select("style_id").join(seen, "style_id", "left").select("style_id", F.coalesce("lv", "nm").alias("level"))


def first_anchor(comments: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each comment with the first paragraph that it is anchored in, NULL for none."""
    a = anchors.groupBy("doc_id", "comment_id").agg(F.min_by("ref", "ordinal").alias("ref"))
    return comments.join(a, ["doc_id", "comment_id"], "left").select("doc_id", "comment_id", "author", "text", "ref")


def style_templates(paras: DataFrame, container: str | None = None) -> DataFrame:
    """For each paragraph the last earlier non-empty one of the same style, part and, if given, container, else the first later one."""
    w = Window.partitionBy("doc_id", "part", F.coalesce("style", F.lit("")), *([container] if container else [])).orderBy("ordinal")
    full = F.when(F.col("text") != "", F.col("ordinal"))
    before = F.last(full, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(full, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return paras.select("doc_id", "ordinal", F.coalesce(before, after).alias("template"))


def call_batches(calls: DataFrame) -> DataFrame:
    """Adjacent safe calls of a turn run together, others alone."""
    w = Window.partitionBy("turn").orderBy("pos")
    new = F.when(F.col("safe") & F.coalesce(F.lag("safe").over(w), F.lit(False)), 0).otherwise(1)
    b = calls.withColumn("new", new).withColumn("batch", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return b.groupBy("turn", "batch").agg(F.count(F.lit(1)).alias("calls"), F.bool_and("safe").alias("parallel"))


def detected_formats(files: DataFrame) -> DataFrame:
    """The format that a file name's extension means."""
    ext = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    kind = F.when(ext.isin(".docx", ".dotx", ".docm"), "docx").when(ext == ".pdf", "pdf").when(ext.isin(".html", ".htm", ".xhtml"), "html").when(ext.isin(".md", ".markdown", ".txt"), "markdown").otherwise("unsupported")
    return files.select("file_id", "name", kind.alias("format"))


def stored_names(files: DataFrame) -> DataFrame:
    """Names safe to store, equal ones told apart by a number before the extension."""
    clean = F.regexp_replace("name", r'[\\/:*?"<>|]', "_")
    again = F.row_number().over(Window.partitionBy("clean").orderBy("file_id")) - 1
    named = files.select("file_id", clean.alias("clean")).withColumn("k", again)
    return named.select("file_id", F.when(F.col("k") == 0, F.col("clean")).otherwise(F.concat(F.regexp_replace("clean", r"\.[^.]+$", ""), F.lit("-"), F.col("k"), F.regexp_extract("clean", r"(\.[^.]+)$", 1))).alias("stored"))


def retries(attempts: DataFrame, most: int = 5) -> DataFrame:
    """What follows each failed request: its kind, whether it is tried again, and the delay in seconds before jitter."""
    kind = F.when(F.col("aborted"), "aborted").when(F.col("status").between(200, 299), "ok").when(F.col("status") == 401, "auth").when(F.col("status") == 402, "balance").when(F.col("status") == 429, "rate_limit").when(F.col("status") >= 500, "server").when(F.col("status") == 0, "network").otherwise("invalid")
    again = kind.isin("rate_limit", "server", "network") & (F.col("attempt") < most)
    return attempts.select("id", kind.alias("kind"), again.alias("again"), F.when(again, F.least(F.lit(30.0), F.pow(F.lit(2.0), F.col("attempt") - 1))).alias("delay"))


def hook_matches(hooks: DataFrame) -> DataFrame:
    """Whether a hook's pattern, anchored at both ends, means a tool; none and * mean all."""
    return hooks.select("id", F.coalesce((F.col("matcher") == "*") | F.expr("tool RLIKE concat('^(?:', nullif(matcher, '*'), ')$')"), F.lit(True)).alias("match"))


def listed_sessions(raw: DataFrame) -> DataFrame:
    """Sessions from their records (id, record: JSON with updatedAt), newest first; records that can't be read are dropped."""
    at = F.from_json("record", "updatedAt DOUBLE", {"mode": "PERMISSIVE"})["updatedAt"]
    return raw.select("id", at.alias("updated_at")).filter("updated_at IS NOT NULL").orderBy(F.col("updated_at").desc(), "id")


def commands(lines: DataFrame, skills: DataFrame) -> DataFrame:
    """What each line (id, text) that begins with a slash calls: its name, the rest, and where the name is from (built in, a skill by name, unknown); an unknown mode is invalid."""
    name, rest = F.regexp_extract("text", r"^/(\S+)", 1), F.trim(F.regexp_extract("text", r"(?s)^/\S+\s+(.*)$", 1))
    c = lines.filter(F.startswith("text", F.lit("/"))).select("id", name.alias("name"), rest.alias("args")).join(skills.select("name", "source").distinct(), "name", "left")
    source = F.when(F.col("name").isin(COMMANDS), "builtin").otherwise(F.coalesce("source", F.lit("unknown")))
    status = F.when(source == "unknown", "not_found").when((F.col("name") == "mode") & (F.col("args") != "") & ~F.col("args").isin(MODES), "invalid").otherwise("ok")
    return c.select("id", "name", "args", source.alias("source"), status.alias("status"))


def compactions(sizes: DataFrame, budget: int = 160_000, micro: float = 0.5, auto: float = 0.75) -> DataFrame:
    """What a conversation of ``before`` tokens, of which folding saves ``saved``, needs within a budget: folding beyond half of it, then a summary if still beyond three quarters."""
    folds = (F.col("before") > budget * micro) & (F.col("saved") > 0)
    after = F.when(folds, F.col("before") - F.col("saved")).otherwise(F.col("before"))
    return sizes.select("id", after.alias("after"), F.when(after > budget * auto, F.when(folds, "micro+auto").otherwise("auto")).when(folds, "micro").otherwise("none").alias("kind"))


def message_tokens(messages: DataFrame) -> DataFrame:
    """Estimated tokens of each session: characters of contents, and of an assistant's reasoning, call names and arguments, by 2.5."""
    own = F.length(F.coalesce("content", F.lit(""))) + F.when(F.col("role") == "assistant", F.length(F.concat_ws("", "reasoning", "calls"))).otherwise(0)
    return messages.groupBy("session").agg(F.ceil(F.sum(own) / 2.5).cast("long").alias("tokens"))


def transcript(messages: DataFrame) -> DataFrame:
    """What is shown of a history (session, idx, role, content, tool_call_id, tool): users' texts without reminders, assistants' texts, results with their tool and whether they went well."""
    shown = F.when(F.col("role") == "user", F.trim(F.regexp_replace("content", r"(?s)<system-reminder>.*?</system-reminder>\s*", ""))).otherwise(F.col("content"))
    w = Window.partitionBy("session", "call").orderBy("idx")
    call = F.coalesce("tool_call_id", "call_id")
    m = messages.withColumn("call", call).withColumn("named", F.last("tool", ignorenulls=True).over(w))
    title = F.when(F.col("role") == "tool", F.coalesce("named", F.lit("工具")))
    out = m.select("session", "idx", F.col("role").alias("kind"), shown.alias("text"), title.alias("title"), F.when(F.col("role") == "tool", ~F.startswith("content", F.lit("错误："))).alias("ok"))
    return out.filter("kind = 'tool' OR trim(coalesce(text, '')) <> ''")
