"""The queries registered for the text operators: each applies its operator to the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, embedding_dedup, language_id, license_scan, minhash, mixing, periodic_runs, pii, quality_classifier, quality_rules, topk_search, url_filter
from .common import table


def tokenizer_path() -> str:
    """Where the installed tokenizer files have the vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_id.train(docs)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, base places and license labels of every document."""
    found = license_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """n_tokens and digests of ids and decoded text of every document; ``path``: the tokenizer file."""
    found = bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text"), path or tokenizer_path())
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and log-likelihood ratio of every document; trusted are those labelled good and not toxic."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    found = quality_rules.judge(docs, quality_rules.train(docs, trusted))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    found = url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"), url_filter.train(spark))
    return found.select("page_id", "host", "path", "rule", "verdict", "p_block")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates of every document."""
    return minhash.deduplicate(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return embedding_dedup.link(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    found = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document; trusted are those labelled good and not toxic."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return quality_classifier.classify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), trusted)


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors with the largest inner product for every vector whose id is divisible by 20."""
    return topk_search.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language."""
    return collocations.mine(table(spark, sf_dir, "documents", "text", "lang"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document; a tenth of them, by the hash of the id, with a repeated tail."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    found = periodic_runs.find(docs, seed=F.when(h % 10 == 0, F.floor(h / 10)))
    return found.select("doc_id", *periodic_runs.digests(found))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 counts by its contract alone: words, base places and base labels."""
    return op1_license_scan(spark, sf_dir).drop("labels", "score")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 counts by its contract alone."""
    return quality_rules.base_rules(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op5."""
    return op5_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of every page, and the verdict where a rule gives it."""
    host, path = url_filter.host_and_path(F.col("url"))
    df = table(spark, sf_dir, "pages", "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = url_filter.matched_rule(F.col("host"), F.col("path"))
    return df.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10's patterns count."""
    return op10_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_bpe": op3_bpe,
    "op4_minhash": op4_minhash,
    "op5_mixing": op5_mixing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_language_id": op7_language_id,
    "op8_url_filter": op8_url_filter,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_pii": op10_pii,
    "op11_topk_search": op11_topk_search,
    "op12_collocations": op12_collocations,
    "op13_periodic_runs": op13_periodic_runs,
    "license_base": license_base,
    "quality_base": quality_base,
    "mix_targets": mix_targets,
    "url_rules": url_rules,
    "pii_counts": pii_counts,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
#: The smallest node that each node of ``nodes`` (id) reaches by ``links`` (a, b), its own included.
_REACH = "reach as (select id, id other from nodes union select r.id, l.b from reach r join (select a, b from links union all select b, a from links) l on l.a = r.other), low as (select id, min(other) component_id from reach group by 1)"
_PLACES = "list_filter(range(1, len(w) + 1), lambda i: array_to_string(w[i:i + {n} - 1], ' ') = '{phrase}' and i + {n} - 1 <= len(w))"
_PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
_LICENSE = ", ".join(_PLACES.format(n=len(p.split()), phrase=p) + f" p{k}" for k, p in enumerate(_PHRASES.values()))

#: DuckDB SQL for the same rows, where SQL can express them.
ORACLE_SQL: dict[str, str] = {
    "op4_minhash": f"""with recursive words as (select doc_id, {_WORDS.format(_LOWER.format("text"))} w from documents),
        sets as (select doc_id, case when len(w) >= 4 then list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end s from words),
        each as (select doc_id, unnest(s) g from sets), shared as (select x.doc_id a, y.doc_id b, count(*) n from each x join each y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
        links as (select a, b from shared join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= 80 * (len(x.s) + len(y.s) - n)), nodes as (select doc_id id from sets), {_REACH}
        select doc_id, len(s) n_shingles, component_id, doc_id = component_id kept from sets join low on low.id = doc_id""",
    "op9_embedding_dedup": f"""with recursive vectors as (select vec_id id, embedding::double[] e from embeddings), nodes as (select id from vectors),
        sound as (select id, e, sqrt(list_dot_product(e, e)) n from vectors where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x != 0)) > 0),
        links as (select x.id a, y.id b from sound x join sound y on x.id < y.id and len(x.e) = len(y.e) where list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.95), {_REACH},
        degree as (select id, count(*) n from (select a id from links union all select b from links) group by 1)
        select v.id vec_id, coalesce(n, 0) n_links, component_id, v.id = component_id kept from vectors v join low on low.id = v.id left join degree d on d.id = v.id""",
    "op11_topk_search": """with sound as (select vec_id id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) w from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scored as (select q.id query_id, c.id vec_id, list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i]))::bigint score from sound q join sound c on q.id % 20 = 0 and q.id != c.id)
        select query_id, row_number() over (partition by query_id order by score desc, vec_id) rank, vec_id, score from scored qualify rank <= 20""",
    "op12_collocations": f"""with pieces as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) p from documents),
        split as (select row_number() over () id, lang, regexp_extract_all(p, '[^\\x20\\x09]+') w from pieces), total as (select lang, sum(len(w))::bigint n from split group by 1),
        places as (select lang, w, unnest(range(1, len(w) + 1)) i from split), each as (select lang, w[i:i + 3] w from places),
        f as (select lang, array_to_string(w[1:k], ' ') p, k, count(*) a from each, (values (1), (2), (3), (4)) v(k) where k <= len(w) group by all having count(*) >= 30),
        long as (select lang, p, a, k, string_split(p, ' ') w, unnest(range(1, k)) j from f where k > 1), parts as (select lang, p, a, j, array_to_string(w[1:j], ' ') head, array_to_string(w[j + 1:], ' ') rest from long),
        cuts as (select c.*, h.a l, t.a r, (2000000::hugeint * c.a) // (h.a + t.a) score from parts c join f h on h.lang = c.lang and h.p = c.head join f t on t.lang = c.lang and t.p = c.rest),
        best as (select distinct on (lang, p) * from cuts order by lang, p, score, j),
        within as (select distinct lang, a, array_to_string(w[i:i + m - 1], ' ') p from (select lang, a, k, w, unnest(range(1, k)) i from long), (values (2), (3)) v(m) where m < k and i + m - 1 <= k),
        most as (select lang, p, max(a) a from within group by 1, 2), kept as (select b.* from best b left join most m using (lang, p) where m.a is null or 100 * m.a < 80 * b.a)
        select lang, row_number() over (partition by lang order by score desc, a desc, p) rank, p phrase, a, l, r, n, score::bigint score from kept join total using (lang) qualify rank <= 2000""",
    "license_base": f"""select doc_id, len(w) n_words, len(p0) + len(p1) + len(p2) n_base, list_min(p0 || p1 || p2) - 1 first_word, list_max(p0 || p1 || p2) - 1 last_word,
        array_to_string(list_filter([case when len(p1) > 0 then 'apache-2' end, case when len(p2) > 0 then 'cc-by-nc' end, case when len(p0) > 0 then 'mit' end], lambda x: x is not null), ',') base_labels
        from (select doc_id, w, {_LICENSE} from (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents))""",
    "quality_base": f"""with words as (select doc_id, coalesce(text, '') t, {_WORDS.format("text")} w from documents),
        windows as (select doc_id, i, array_to_string(w[i:i + 2], ' ') g from words, unnest(range(1, len(w) - 1)) u(i)),
        twice as (select doc_id, i from windows qualify count(*) over (partition by doc_id, g) > 1), repeated as (select doc_id, count(distinct i + k) n from twice, unnest([0, 1, 2]) u(k) group by 1),
        lines as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l from words)
        select doc_id, len(w) n_words, length(array_to_string(w, '')) word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols, len(l) - len(list_distinct(l)) n_dup_lines, coalesce(n, 0) n_repeat_words,
        len(w) < 50 or 100 * coalesce(n, 0) > 50 * len(w) base_failed from words join lines using (doc_id) left join repeated using (doc_id)""",
    "mix_targets": f"""with sized as (select doc_id, source, len({_WORDS.format("text")}) size from documents), total as (select source, sum(size)::bigint n from sized group by 1),
        ranked as (select *, [5.0, 2.0, 1.0][(row_number() over (order by source is null, source) - 1) % 3 + 1]::double w from total), ratio as (select *, row_number() over (order by 3 * n / w, source) k from ranked),
        level as (select k, 3 * n / w most, ((select sum(n) from total) - coalesce(sum(3 * n) over (order by k rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by k rows between current row and unbounded following) v from ratio),
        found as (select min_by(v, k) v from level where v <= most)
        select doc_id, size, n source_size, round(least(3 * n, w * coalesce(v, 1e300)), 6) target from sized s join ratio r on s.source is not distinct from r.source, found""",
    "url_rules": f"""with rest as (select page_id, case when contains(url, '://') then url[strpos(url, '://') + 3:] else '' end r from pages), cut as (select page_id, {_LOWER.format("regexp_extract(r, '^[^/?#]*')")} host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path from rest),
        hit as (select page_id, h, p, v, length(h || p) n from cut join (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(h, p, v) on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)),
        best as (select page_id, max_by(h || p, n) rule, max_by(v, n) verdict from hit group by 1) select page_id, host, path, rule, verdict from cut left join best using (page_id)""",
    "pii_counts": """with found as (select doc_id, coalesce(text, '') t from documents), lists as (select doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+') email, regexp_extract_all(t, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)') ip,
        list_transform(regexp_extract_all(t, '[0-9]([\\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) card, list_transform(regexp_extract_all(t, '\\+[0-9][\\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) phone from found)
        select doc_id, len(email) n_email, len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 or coalesce(try_cast(p as int), 0) > 255)) = 0)) n_ip,
        len(list_filter(card, lambda d: length(d) between 13 and 19 and list_sum(list_transform(range(0, length(d)), lambda i: case when i % 2 = 0 then d[length(d) - i]::int else (2 * d[length(d) - i]::int) // 10 + (2 * d[length(d) - i]::int) % 10 end)) % 10 = 0)) n_card,
        len(list_filter(phone, lambda d: length(d) between 9 and 15)) n_phone from lists""",
}
