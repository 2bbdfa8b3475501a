"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planloom.llm.chat import loss_texts, messages, read_back, rendered
from planloom.llm.embeddings import linked_vectors
from planloom.llm.fingerprints import edited_fingerprints
from planloom.llm.minhash import near_duplicates
from planloom.llm.mixing import mix
from planloom.llm.packing import packed
from planloom.llm.phrases import collocations
from planloom.llm.quality import quality_scores
from planloom.llm.rules import judged
from planloom.llm.suffix import without_repeats
from planloom.llm.tokens import counted, token_counts
from planloom.llm.warc import derivatives, responses
from planloom.llm.whitening import whitened_vectors


def _table(spark: SparkSession, table_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{table_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, table_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents over two-word shingles."""
    return near_duplicates(_table(spark, table_dir, "documents"), width=2, percent=80)


def op2_quality_classifier(spark: SparkSession, table_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality_scores(_table(spark, table_dir, "documents"), _table(spark, table_dir, "labels"))


def tokenizer_file(name: str) -> str:
    """Where the box keeps a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_token_counts(spark: SparkSession, table_dir: str) -> DataFrame:
    """Tokens of all documents."""
    return token_counts(_table(spark, table_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=1024)


def op4_quality_rules(spark: SparkSession, table_dir: str) -> DataFrame:
    """All documents judged by the base rules and the learned decision list."""
    return judged(_table(spark, table_dir, "documents"), _table(spark, table_dir, "labels"))


def op5_pfair_mixing(spark: SparkSession, table_dir: str) -> DataFrame:
    """All documents in a mix of their sources weighted by the square root of their bytes."""
    return mix(_table(spark, table_dir, "documents"), power=0.5, block_bytes=65536)


def op7_length_bucket_packing(spark: SparkSession, table_dir: str) -> DataFrame:
    """All documents in batches of 65,536 padded tokens from 16 length buckets."""
    docs = counted(_table(spark, table_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), "doc_id", "text")
    return packed(docs, F.col("n_tokens"), buckets=16, budget=65536)


# Characters of a streamed piece of an assistant's answer.
DELTA = 512


def chat_events(conversations: DataFrame) -> DataFrame:
    """The conversations as a log: answers arrive as a message and deltas, other rows as one message each.

    Every row is a turn of its own, also where a turn number is repeated.
    """
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", F.row_number().over(by_turn).cast("long").alias("turn"), "role", "text")
    pieces = F.when(F.col("role") == "assistant", F.ceil(F.length("text") / DELTA)).otherwise(1)
    pieces = F.greatest(F.coalesce(pieces, F.lit(1)), F.lit(1)).cast("int")
    cut = rows.select("*", F.explode(F.sequence(F.lit(1), pieces)).alias("piece"), pieces.alias("pieces"))
    part = F.substr("text", (F.col("piece") - 1) * DELTA + 1, F.lit(DELTA))
    return cut.select(
        "conv_id",
        (F.col("turn") * (1 << 32) + F.col("piece")).alias("seq"),
        "turn",
        F.when(F.col("piece") == 1, "message").otherwise("delta").alias("kind"),
        "role",
        F.when(F.col("pieces") == 1, F.col("text")).otherwise(part).alias("text"),
    )


def op6_chat_formatting(spark: SparkSession, table_dir: str) -> DataFrame:
    """All conversations rebuilt from events, rendered, and read back from the rendered text."""
    conversations = _table(spark, table_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-1), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(control)
    )
    formatted = rendered(messages(chat_events(conversations.union(added))))
    read = formatted.select(
        "conv_id",
        "formatted",
        read_back(F.col("formatted")).alias("turns"),
        F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
    with all_rows as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
    ),
    shown as (
        select *, regexp_replace(text, '(<|\[)(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') as safe from all_rows
    )
    select conv_id,
           count(*) as n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
           coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
           sha256(coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '')) as loss_sha256,
           sum(3 + length(role) + 1 + length(safe) + 4)::bigint as formatted_chars
    from shown group by conv_id
"""


def op8_warc_derivatives(spark: SparkSession, table_dir: str) -> DataFrame:
    """Conversion and metadata records of all pages."""
    return derivatives(responses(_table(spark, table_dir, "pages")))


def op9_embedding_near_dedup(spark: SparkSession, table_dir: str) -> DataFrame:
    """Near-duplicate groups of all vectors at cosine 0.98."""
    return linked_vectors(_table(spark, table_dir, "embeddings"), cosine=0.98)


def op10_suffix_dedup(spark: SparkSession, table_dir: str) -> DataFrame:
    """Bytes of all documents without the 200-byte strings that start anywhere else."""
    return without_repeats(_table(spark, table_dir, "documents"), length=200).select(
        "doc.doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


def op11_phrase_collocations(spark: SparkSession, table_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language over all documents."""
    return collocations(_table(spark, table_dir, "documents"), least=30, longest=4, covered=80, factor=2_000_000, top=2000)


def op12_embedding_whitening(spark: SparkSession, table_dir: str) -> DataFrame:
    """All vectors projected on the four main components of the distinct ones, with unit variance."""
    return whitened_vectors(_table(spark, table_dir, "embeddings"), components=4, scale=256)


def op13_document_fingerprints(spark: SparkSession, table_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with the likeness of both and to the next document."""
    return edited_fingerprints(_table(spark, table_dir, "documents"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_token_counts": op3_token_counts,
    "op4_quality_rules": op4_quality_rules,
    "op5_pfair_mixing": op5_pfair_mixing,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_length_bucket_packing": op7_length_bucket_packing,
    "op8_warc_derivatives": op8_warc_derivatives,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_document_fingerprints": op13_document_fingerprints,
}

OP1_SQL = r"""
    with recursive words as (
        select doc_id, regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x20\x09-\x0D]+') as w
        from documents
    ),
    shingles as (
        select distinct doc_id, unnest(case when len(w) < 2 then w
                                            else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as g
        from words
    ),
    sizes as (select doc_id, count(*) as n from shingles group by doc_id),
    pairs as (
        select a.doc_id as x, b.doc_id as y, count(*) as common
        from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by all
    ),
    links as (
        select x, y from pairs join sizes s on s.doc_id = x join sizes t on t.doc_id = y
        where 100 * common >= 80 * (s.n + t.n - common)
    ),
    both_ways as (select x, y from links union select y, x from links),
    reached as (
        select doc_id as x, doc_id as y from documents
        union
        select r.x, l.y from reached r join both_ways l on r.y = l.x
    ),
    lowest as (select x, min(y) as component_id from reached group by x)
    select d.doc_id, coalesce(s.n, 0) as n_shingles, l.component_id, d.doc_id = l.component_id as kept
    from documents d join lowest l on l.x = d.doc_id left join sizes s on s.doc_id = d.doc_id
"""

OP9_SQL = """
    with recursive sound as (
        select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
        where label is not null and len(embedding) > 0
          and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
          and len(list_filter(embedding, lambda x: x <> 0)) > 0
    ),
    links as (
        select a.vec_id as x, b.vec_id as y
        from sound a join sound b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
        where list_cosine_similarity(a.e, b.e) >= 0.98
    ),
    reached as (
        select vec_id as x, vec_id as y from embeddings
        union
        select r.x, l.y from reached r join links l on r.y = l.x
    ),
    lowest as (select x, min(y) as component_id from reached group by x),
    counts as (select x, count(*) as n from links group by x)
    select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
    from embeddings join lowest on lowest.x = vec_id left join counts on counts.x = vec_id
"""

OP10_SQL = """
    with texts as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
    starts as (
        select doc_id, p, h[2 * p + 1 : 2 * p + 400] as s
        from (select doc_id, h, unnest(range(length(h) // 2 - 199)) as p from texts)
    ),
    repeated as (
        select doc_id, p from (select doc_id, p, count(*) over (partition by s) as n from starts) where n > 1
    ),
    -- runs of repeated starts whose strings touch or overlap
    marked as (
        select doc_id, p, p - coalesce(lag(p) over (partition by doc_id order by p), -1000) > 200 as opens from repeated
    ),
    runs as (
        select doc_id, min(p) as first, max(p) + 200 as after
        from (select *, sum(opens::int) over (partition by doc_id order by p) as run from marked) group by doc_id, run
    ),
    gaps as (
        select doc_id, coalesce(lag(after) over (partition by doc_id order by first), 0) as a, first as b from runs
        union all
        select doc_id, max(after), 2000000000 from runs group by doc_id
    ),
    kept as (
        select g.doc_id, string_agg(t.h[2 * a + 1 : 2 * b], '' order by a) as h
        from gaps g join texts t on t.doc_id = g.doc_id group by g.doc_id
    ),
    spans as (select doc_id, count(*) as n from runs group by doc_id)
    select t.doc_id, length(t.h) // 2 as n_bytes, (length(t.h) - length(coalesce(k.h, t.h))) // 2 as n_removed,
           coalesce(s.n, 0) as n_spans, sha256(unhex(coalesce(k.h, t.h))) as kept_sha256
    from texts t left join kept k on k.doc_id = t.doc_id left join spans s on s.doc_id = t.doc_id
"""

OP11_SQL = r"""
    with pieces as (
        select row_number() over () as piece, lang, regexp_extract_all(p, '[^\x20\x09]+') as w
        from (
            select coalesce(lang, 'und') as lang, unnest(string_split_regex(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[.,;:!?\x0A-\x0D]')) as p
            from documents
        )
    ),
    totals as (select lang, sum(len(w))::bigint as n from pieces group by lang),
    places as (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces, (select unnest([1, 2, 3, 4]) as k)),
    f as (
        select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase, count(*) as a
        from places group by all having count(*) >= 30
    ),
    candidates as (select *, string_split(phrase, ' ') as w from f where k > 1),
    cuts as (
        select lang, phrase, k, a, cut, array_to_string(w[1 : cut], ' ') as first, array_to_string(w[cut + 1 :], ' ') as rest
        from (select *, unnest(range(1, k)) as cut from candidates)
    ),
    scored as (
        select c.lang, c.phrase, c.k, c.a, cut, x.a as l, y.a as r,
               ((2000000::hugeint * c.a::hugeint) // (x.a::hugeint + y.a::hugeint))::bigint as score
        from cuts c
        join f x on x.lang = c.lang and x.phrase = first and x.k = cut
        join f y on y.lang = c.lang and y.phrase = rest and y.k = c.k - cut
    ),
    best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
    inner_phrases as (
        select lang, a, array_to_string(w[i : i + size - 1], ' ') as phrase
        from (
            select lang, k, a, w, size, unnest(range(1, k - size + 2)) as i
            from (select *, unnest(range(2, k)) as size from candidates where k > 2)
        )
    ),
    longer as (select lang, phrase, max(a) as most from inner_phrases group by lang, phrase),
    kept as (
        select b.* from best b left join longer o on o.lang = b.lang and o.phrase = b.phrase
        where o.most is null or 100 * o.most < 80 * b.a
    ),
    ranked as (
        select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept
    )
    select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": OP1_SQL,
    "op6_chat_formatting": OP6_SQL,
    "op9_embedding_near_dedup": OP9_SQL,
    "op10_suffix_dedup": OP10_SQL,
    "op11_phrase_collocations": OP11_SQL,
}
