"""DuckDB SQL for the queries, written from the operators' definitions."""

from __future__ import annotations

_LETTERS = "ATCGND"

_WITH = r"""
WITH RECURSIVE d1 AS (SELECT event_id AS e, event_id // 40 AS locus, event_id % 40 AS j FROM events),
d2 AS (SELECT *, (j * 7 + locus) % 4 AS mol, (j * 13) % 17 AS off, locus // 5 AS rw FROM d1),
d3 AS (SELECT *, 20 - off AS k, rw * 80 + CASE WHEN rw % 7 = 3 THEN 30 ELSE 0 END + off AS pos,
  CASE WHEN e % 10 = 1 THEN 1 WHEN mol = 2 THEN 2 WHEN mol = 3 THEN 3 ELSE 0 END AS form, ((locus * 4 + mol) * 40503 + 977) % 65536 AS code FROM d2),
d4 AS (SELECT *, array_to_string(list_transform(range(0, 8), lambda q: substr('ATCG', ((code >> (2 * q)::INT) & 3)::INT + 1, 1)), '') AS tag0,
  list_transform(range(0, 30), lambda q: pos + q - CASE WHEN form = 1 THEN 3 WHEN form = 2 AND q >= k THEN -2 WHEN form = 3 AND q >= k THEN 2 ELSE 0 END) AS places FROM d3),
d5 AS (SELECT *, CASE WHEN e % 13 = 0 THEN 'A' || substr(tag0, 2, 7) WHEN e % 17 = 0 THEN substr(tag0, 1, 7) WHEN e % 29 = 3 THEN 'NA' ELSE tag0 END AS tg FROM d4),
aln AS MATERIALIZED (SELECT 'q' || e || '_F1_' || tg || '_F2_NA_R1_GC' || substr(tag0, 1, 6) || '_R2_NA' AS qname, 'chr' || (locus % 5 + 1) AS region, pos, 20 + e % 41 AS mapq,
  (CASE WHEN e % 11 = 5 THEN 83 WHEN e % 19 = 7 THEN 67 WHEN e % 2 = 0 THEN 99 ELSE 147 END + CASE WHEN e % 23 = 4 THEN 1024 ELSE 0 END)::BIGINT AS flag,
  CASE form WHEN 0 THEN '30M' WHEN 1 THEN '3S27M' WHEN 2 THEN k || 'M2D' || (30 - k) || 'M' ELSE k || 'M2I' || (28 - k) || 'M' END AS cigar,
  array_to_string(list_transform(places, lambda p, i: CASE WHEN form = 3 AND i - 1 = k THEN 'G' WHEN form = 3 AND i = k + 2 THEN 'T' ELSE
    substr('ATCG', (((p * p * 7 + p * 3 + 5) // 11 + CASE WHEN (p * 31 + mol * 7) % 23 = 0 THEN 1 ELSE 0 END + CASE WHEN (e * 37 + (i - 1) * 11) % 47 = 0 THEN 2 ELSE 0 END) % 4)::INT + 1, 1) END), '') AS seq,
  array_to_string(list_transform(range(0, 30), lambda q: chr((53 + (e + q) % 21)::INT)), '') AS qual FROM d5),
ref AS MATERIALIZED (SELECT 'chr' || c AS region, p AS pos, substr('ATCG', (((p * p * 7 + p * 3 + 5) // 11) % 4)::INT + 1, 1) AS ref_base
  FROM (SELECT unnest(range(0, (SELECT ((max(event_id) // 40) // 5) * 80 + 80 + 10 FROM events))) AS p), (SELECT unnest(range(1, 6)) AS c)),
contigs AS (SELECT row_number() OVER (ORDER BY region) - 1 AS contig_idx, region, num_reads FROM (SELECT region, count(*) AS num_reads FROM aln GROUP BY region)),
parsed AS (SELECT *, coalesce(t[3], '') AS f1, coalesce(t[5], '') AS f2, coalesce(t[7], '') AS r1, coalesce(t[9], '') AS r2 FROM (SELECT *, string_split(qname, '_') AS t FROM aln)),
classed AS (SELECT *, (flag & 16) = 0 AS is_forward, CASE
  WHEN ((flag & 64) <> 0 AND (flag & 16) = 0 AND (flag & 32) <> 0) OR ((flag & 128) <> 0 AND (flag & 16) <> 0 AND (flag & 32) = 0) THEN 'FR'
  WHEN ((flag & 64) <> 0 AND (flag & 16) <> 0 AND (flag & 32) = 0) OR ((flag & 128) <> 0 AND (flag & 16) = 0 AND (flag & 32) <> 0) THEN 'RF'
  WHEN (flag & 48) = 0 THEN 'FF' WHEN (flag & 48) = 48 THEN 'RR' END AS orientation FROM parsed),
swapped AS (SELECT * EXCLUDE (f1, f2, r1, r2), CASE orientation WHEN 'RF' THEN r1 ELSE f1 END AS f1, CASE orientation WHEN 'RF' THEN r2 ELSE f2 END AS f2,
  CASE orientation WHEN 'RF' THEN f1 ELSE r1 END AS r1, CASE orientation WHEN 'RF' THEN f2 ELSE r2 END AS r2 FROM classed),
masked AS (SELECT *, ((length(f1) >= 3)::INT + 2 * (length(f2) >= 3)::INT + 4 * (length(r1) >= 3)::INT + 8 * (length(r2) >= 3)::INT)::BIGINT AS tag_mask FROM swapped),
rd AS MATERIALIZED (SELECT *, start + length AS "end", rpad(reverse(right(letters, 16)), 16, 'N') AS tag16, translate(lpad(right(letters, 16), 16, 'N'), 'NATCGD', '012345') AS tag_key
  FROM (SELECT row_number() OVER () AS rid, qname, flag, region, pos AS start, mapq, cigar, seq, qual, orientation, is_forward, f1 AS tag, regexp_replace(f1, '[^NATCGD]', 'N', 'g') AS letters,
    coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\d+)[MD]', 1), lambda n: n::BIGINT)), 0)::BIGINT AS length
  FROM masked WHERE (flag & 3852) = 0 AND (flag & 3) = 3 AND orientation IS NOT NULL AND tag_mask IN (1, 4, 5, 6, 9, 15) AND length(f1) >= 3)),
reach AS (SELECT *, max("end") OVER (PARTITION BY region ORDER BY start, qname, flag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM rd),
blk AS MATERIALIZED (SELECT * EXCLUDE (before), (sum(CASE WHEN before IS NULL OR start >= before + 10 THEN 1 ELSE 0 END) OVER (PARTITION BY region ORDER BY start, qname, flag ROWS UNBOUNDED PRECEDING))::BIGINT AS block_id FROM reach),
edges_b AS (SELECT region, block_id, p, sum(d) AS d FROM (SELECT region, block_id, start AS p, 1 AS d FROM blk UNION ALL SELECT region, block_id, "end", -1 FROM blk) GROUP BY ALL),
depth_b AS (SELECT region, block_id, max(s)::BIGINT AS max_depth FROM (SELECT region, block_id, sum(d) OVER (PARTITION BY region, block_id ORDER BY p) AS s FROM edges_b) GROUP BY ALL),
blocks AS MATERIALIZED (SELECT region, block_id, start, "end", "end" - start AS length, n_reads, max_depth FROM (SELECT region, block_id, min(start) AS start, max("end") AS "end", count(*) AS n_reads FROM blk GROUP BY ALL) JOIN depth_b USING (region, block_id)),
vb AS (SELECT * FROM blocks WHERE n_reads >= 5 AND max_depth >= 5),
vr AS MATERIALIZED (SELECT blk.* FROM blk JOIN vb USING (region, block_id)),
tags AS MATERIALIZED (SELECT region, block_id, tag_key, tag16, count(*) AS n_reads FROM vr GROUP BY ALL),
pairs AS MATERIALIZED (SELECT a.region, a.block_id, a.tag_key AS key_a, b.tag_key AS key_b, a.tag16 AS tag_a, b.tag16 AS tag_b, (list_sum(list_transform(['N', 'A', 'T', 'C', 'G'],
    lambda c: abs((length(a.tag16) - length(replace(a.tag16, c, ''))) - (length(b.tag16) - length(replace(b.tag16, c, '')))))) // 2)::BIGINT AS bound
  FROM tags a JOIN tags b ON a.region = b.region AND a.block_id = b.block_id AND a.tag_key < b.tag_key),
near AS MATERIALIZED (SELECT *, levenshtein(tag_a, tag_b) AS dist FROM pairs WHERE levenshtein(tag_a, tag_b) <= 2),
walk AS (SELECT region, block_id, tag_key AS a, tag_key AS b FROM tags UNION
  SELECT w.region, w.block_id, w.a, n.b FROM walk w JOIN (SELECT region, block_id, key_a AS a, key_b AS b FROM near UNION ALL SELECT region, block_id, key_b, key_a FROM near) n ON w.region = n.region AND w.block_id = n.block_id AND w.b = n.a),
clusters AS MATERIALIZED (SELECT tags.*, allele_key FROM tags JOIN (SELECT region, block_id, a AS tag_key, min(b) AS allele_key FROM walk GROUP BY ALL) USING (region, block_id, tag_key)),
cr AS (SELECT vr.*, allele_key FROM vr JOIN clusters USING (region, block_id, tag_key)),
edges_a AS (SELECT region, block_id, allele_key, p, sum(d) AS d FROM (SELECT region, block_id, allele_key, start AS p, 1 AS d FROM cr UNION ALL SELECT region, block_id, allele_key, "end", -1 FROM cr) GROUP BY ALL),
depth_a AS (SELECT region, block_id, allele_key, max(s)::BIGINT AS max_depth FROM (SELECT region, block_id, allele_key, sum(d) OVER (PARTITION BY region, block_id, allele_key ORDER BY p) AS s FROM edges_a) GROUP BY ALL),
alleles AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY region, block_id ORDER BY allele_key) AS allele_id FROM (SELECT region, block_id, allele_key, min(start) AS start, max("end") AS "end", count(*) AS n_reads, any_value(max_depth) AS max_depth FROM cr JOIN depth_a USING (region, block_id, allele_key) GROUP BY ALL) WHERE n_reads >= 5 AND max_depth >= 5),
ar AS MATERIALIZED (SELECT cr.*, allele_id FROM cr JOIN (SELECT region, block_id, allele_key, allele_id FROM alleles) USING (region, block_id, allele_key)),
ops0 AS (SELECT rid, unnest(range(1, len(n) + 1)) AS i, n, o FROM (SELECT rid, regexp_extract_all(cigar, '(\d+)([MIDSH])', 1) AS n, regexp_extract_all(cigar, '(\d+)([MIDSH])', 2) AS o FROM rd)),
ops1 AS (SELECT rid, i - 1 AS idx, o[i] AS op, n[i]::BIGINT AS len FROM ops0),
ops AS MATERIALIZED (SELECT *, coalesce(sum(CASE WHEN op IN ('M', 'D') THEN len ELSE 0 END) OVER w, 0)::BIGINT AS ref_off, coalesce(sum(CASE WHEN op IN ('M', 'I', 'S') THEN len ELSE 0 END) OVER w, 0)::BIGINT AS query_off
  FROM ops1 WINDOW w AS (PARTITION BY rid ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cells AS (SELECT rid, op, ref_off, query_off, unnest(range(0, len)) AS i FROM ops WHERE op IN ('M', 'D')),
obs AS MATERIALIZED (SELECT rid, region, mapq, start + ref_off + i AS pos, CASE WHEN op = 'D' THEN 'D' WHEN substr(seq, (query_off + i)::INT + 1, 1) IN ('A', 'T', 'C', 'G') THEN substr(seq, (query_off + i)::INT + 1, 1) ELSE 'N' END AS base,
  CASE WHEN op = 'D' THEN 50 ELSE ascii(substr(qual, (query_off + i)::INT + 1, 1)) - 33 END AS phred FROM cells JOIN rd USING (rid)),
ins AS MATERIALIZED (SELECT rid, qname, region, start + ref_off AS pos, substr(seq, query_off::INT + 1, len::INT) AS bases, list_transform(range(0, len), lambda q: ascii(substr(qual, (query_off + q)::INT + 1, 1)) - 33) AS phreds FROM ops JOIN rd USING (rid) WHERE op = 'I'),
votes AS MATERIALIZED (SELECT region, block_id, allele_id, pos, count(*) AS cov, sum(mapq)::BIGINT AS mapq_sum, COUNTS, SUMS, any_value(ref_base) AS ref_base, count(*) FILTER (base <> ref_base) AS deviations
  FROM (SELECT obs.*, ar.block_id, ar.allele_id FROM obs JOIN ar USING (rid)) JOIN ref USING (region, pos) GROUP BY ALL),
av AS (SELECT * FROM votes WHERE deviations > 0 AND cov >= 5 AND (cov - deviations)::FLOAT < 0.7::FLOAT * cov::FLOAT),
vp AS MATERIALIZED (SELECT DISTINCT region, block_id, pos FROM av),
at_vp AS (SELECT votes.* FROM votes JOIN vp USING (region, block_id, pos) WHERE cov >= 5),
sup AS (SELECT i.*, v.block_id, v.allele_id, v.cov, v.mapq_sum FROM (SELECT ins.*, ar.block_id, ar.allele_id FROM ins JOIN ar USING (rid)) i JOIN votes v ON i.region = v.region AND i.block_id = v.block_id AND i.allele_id = v.allele_id AND i.pos = v.pos WHERE v.cov >= 5),
sites AS (SELECT region, block_id, allele_id, pos, count(*) AS n_ins, max(cov) AS cov, max(mapq_sum) AS mapq_sum FROM sup GROUP BY ALL HAVING count(*) <= max(cov) AND (max(cov) - count(*))::FLOAT < 0.7::FLOAT * max(cov)::FLOAT),
letters AS (SELECT region, block_id, allele_id, pos, unnest(range(0, length(bases))) AS insertion_index, bases, phreds FROM sup),
ins_votes AS (SELECT region, block_id, allele_id, pos, insertion_index, any_value(cov) AS cov, any_value(mapq_sum) AS mapq_sum, 'D' AS ref_base, INS_COUNTS, any_value(cov) - count(*) AS n_d, INS_SUMS, (any_value(cov) - count(*)) * 50 AS q_d
  FROM (SELECT region, block_id, allele_id, pos, insertion_index, substr(bases, insertion_index::INT + 1, 1) AS base, phreds[insertion_index + 1] AS phred FROM letters) JOIN sites USING (region, block_id, allele_id, pos) GROUP BY ALL),
voted AS (SELECT region, block_id, allele_id, pos, false AS is_insertion, 0::BIGINT AS insertion_index, cov, mapq_sum, ref_base, NAMES FROM at_vp
  UNION ALL SELECT region, block_id, allele_id, pos, true, insertion_index, cov, mapq_sum, ref_base, NAMES FROM ins_votes),
best AS (SELECT *, greatest(N_NAMES) AS most FROM voted),
judged AS (SELECT *, TIES AS ties FROM best),
cons0 AS (SELECT *, CASE WHEN ties > 1 THEN 'N' LETTER END AS base, ties > 1 AS is_ambiguous, ties <= 1 AND NOT (most::FLOAT < 0.7::FLOAT * cov::FLOAT) AS is_conclusive, AVERAGES, mapq_sum // cov AS avg_mapq FROM judged),
cons AS MATERIALIZED (SELECT * FROM (SELECT *, max(CASE WHEN is_insertion AND base = 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY region, block_id, allele_id, pos, is_insertion ORDER BY insertion_index) AS ended FROM cons0) WHERE ended = 0),
pools AS (SELECT region, block_id, pos, is_insertion, CASE WHEN is_insertion THEN allele_id ELSE 0 END AS pool_allele, any_value(ref_base) AS ref,
  coalesce(string_agg(CASE WHEN is_conclusive THEN base ELSE lower(base) END, ',' ORDER BY allele_id, insertion_index) FILTER (base = ref_base), '.') AS ref_alleles,
  coalesce(string_agg(CASE WHEN is_conclusive THEN base ELSE lower(base) END, ',' ORDER BY allele_id, insertion_index) FILTER (base <> ref_base), '.') AS alt_alleles, count(*) AS n_alleles,
  string_agg('(' || n_a || ',' || n_t || ',' || n_c || ',' || n_g || ',' || n_n || ',' || n_d || ';' || allele_id || ')', ',' ORDER BY allele_id, insertion_index) AS bases,
  string_agg('(' || avg_a || ',' || avg_t || ',' || avg_c || ',' || avg_g || ',' || avg_n || ',' || avg_d || ';' || allele_id || ')', ',' ORDER BY allele_id, insertion_index) AS phreds,
  string_agg('(' || avg_mapq || ';' || allele_id || ')', ',' ORDER BY allele_id, insertion_index) AS mapqs FROM cons GROUP BY ALL),
vrows AS (SELECT contig_idx, pools.* FROM pools JOIN contigs USING (region)),
at_pos AS (SELECT region, block_id, pos, count(*) AS n_alleles FROM votes WHERE cov >= 5 GROUP BY ALL),
counters AS (SELECT count(*) AS total, count(*) FILTER (is_conclusive) AS conclusive, count(*) FILTER (is_ambiguous) AS ambiguous,
  count(*) FILTER (is_insertion) AS total_ins, count(*) FILTER (is_insertion AND is_conclusive) AS conclusive_ins, count(*) FILTER (is_insertion AND is_ambiguous) AS ambiguous_ins,
  count(*) FILTER (NOT is_insertion AND base = 'D') AS total_del, count(*) FILTER (NOT is_insertion AND base = 'D' AND is_conclusive) AS conclusive_del, count(*) FILTER (NOT is_insertion AND base = 'D' AND NOT is_conclusive) AS inconclusive_del FROM cons)
"""
_FILL = {
    "INS_COUNTS": ", ".join(f"count(*) FILTER (base = '{b}') AS n_{b.lower()}" for b in _LETTERS if b != "D"),
    "INS_SUMS": ", ".join(f"coalesce(sum(phred) FILTER (base = '{b}'), 0)::BIGINT AS q_{b.lower()}" for b in _LETTERS if b != "D"),
    "COUNTS": ", ".join(f"count(*) FILTER (base = '{b}') AS n_{b.lower()}" for b in _LETTERS),
    "SUMS": ", ".join(f"coalesce(sum(phred) FILTER (base = '{b}'), 0)::BIGINT AS q_{b.lower()}" for b in _LETTERS),
    "N_NAMES": ", ".join(f"n_{b.lower()}" for b in _LETTERS),
    "NAMES": ", ".join(f"{k}_{b.lower()}" for k in "nq" for b in _LETTERS),
    "TIES": " + ".join(f"(n_{b.lower()} = most)::INT" for b in _LETTERS),
    "LETTER": " ".join(f"WHEN n_{b.lower()} = most THEN '{b}'" for b in _LETTERS),
    "AVERAGES": ", ".join(f"CASE WHEN n_{b.lower()} = 0 THEN 0 ELSE q_{b.lower()} // n_{b.lower()} END AS avg_{b.lower()}" for b in _LETTERS),
}
for _k, _v in _FILL.items():
    _WITH = _WITH.replace(_k, _v)

_PCT = "CASE WHEN {1} = 0 THEN '-' ELSE printf('%.2f', 100.0 * {0} / {1}) END"
_SUMMARY = """coalesce(count(v), 0) AS n, coalesce(min(v), 0)::BIGINT AS min, coalesce(list_sort(list(v))[(count(v) // 4) + 1], 0)::BIGINT AS q1, coalesce(list_sort(list(v))[(2 * count(v) // 4) + 1], 0)::BIGINT AS q2,
coalesce(list_sort(list(v))[(3 * count(v) // 4) + 1], 0)::BIGINT AS q3, coalesce(max(v), 0)::BIGINT AS max, coalesce(sum(v), 0)::BIGINT AS sum"""
_MOMENTS = "round(coalesce(avg(v), 0.0), 6) AS mean, round(coalesce(stddev_pop(v), 0.0), 6) AS stddev, round(coalesce(stddev_pop(v) / sqrt(count(v)), 0.0), 6) AS stderr, round(coalesce(var_pop(v), 0.0), 6) AS var"
_CONS = "region, block_id, allele_id, pos, insertion_index, ref_base, base, cov, is_conclusive, is_ambiguous, " + ", ".join(f"{k}_{b.lower()}" for k in ("n", "avg") for b in _LETTERS) + ", avg_mapq"
_LINE = "'TMPVARCALL ' || region || chr(9) || pos || chr(9) || ref || chr(9) || ref_alleles || chr(9) || alt_alleles || chr(9) || n_alleles || chr(9) || bases || chr(9) || phreds || chr(9) || mapqs"
_HIST = "SELECT CASE WHEN n_alleles > 10 THEN 0 ELSE n_alleles END AS bucket, count(*) AS n FROM {0} GROUP BY 1"
_DROPOUT = "SELECT '{0}' AS \"of\", count(*) AS positions, count(*) FILTER (n_alleles = 1) AS one_allele, count(*) FILTER (n_alleles = 2) AS two_alleles, count(*) FILTER (n_alleles >= 3) AS more_alleles, " + _PCT.format("count(*) FILTER (n_alleles = 1)", "count(*)") + " AS dropout_pct FROM {1}"
_DERIVED = """SELECT *, {0} FROM (SELECT *, total_snp - conclusive_snp - ambiguous_snp AS inconclusive_snp FROM (SELECT *, total - conclusive - ambiguous AS inconclusive, total_ins - conclusive_ins - ambiguous_ins AS inconclusive_ins, total - total_ins - total_del AS total_snp,
conclusive - conclusive_ins - conclusive_del AS conclusive_snp, ambiguous - ambiguous_ins AS ambiguous_snp FROM counters))""".format(", ".join(_PCT.format(c, "total") + f" AS {c}_pct" for c in ("conclusive", "inconclusive", "ambiguous", "total_snp", "total_ins", "total_del")))

_SELECTS = {
    "scan_region": "SELECT qname, region, pos, flag, mapq, cigar FROM aln WHERE region = 'chr2'",
    "contig_catalog": "SELECT * FROM contigs",
    "reference_slice": "SELECT vb.region, block_id, start, \"end\", string_agg(upper(ref_base), '' ORDER BY pos) AS ref_seq FROM vb JOIN ref ON ref.region = vb.region AND pos >= start AND pos < \"end\" GROUP BY ALL",
    "fasta_slice": "SELECT vb.region, block_id, start, \"end\", string_agg(upper(ref_base), '' ORDER BY pos) AS ref_seq FROM vb JOIN ref ON ref.region = vb.region AND pos >= start AND pos < \"end\" WHERE vb.region IN ('chr2', 'chr4') GROUP BY ALL",
    "filter_mapq": "SELECT qname, flag, mapq FROM aln WHERE mapq >= 30",
    "filter_flags": "SELECT qname, flag FROM aln WHERE (flag & 3852) = 0",
    "filter_strand": "SELECT qname, flag FROM aln WHERE (flag & 16) = 0",
    "filter_pair": "SELECT qname, flag FROM aln WHERE (flag & 3) = 3",
    "tag_parse": "SELECT qname, f1, f2, r1, r2 FROM parsed",
    "orientation": "SELECT qname, flag, orientation, is_forward FROM classed",
    "tag_swap": "SELECT qname, orientation, f1, f2, r1, r2 FROM swapped",
    "filter_orientation": "SELECT qname, orientation FROM classed WHERE orientation IN ('FR', 'FF')",
    "tag_mask": "SELECT qname, tag_mask FROM masked",
    "tag_mask_filter": "SELECT qname, tag_mask FROM masked WHERE tag_mask IN (1, 4, 5, 6, 9, 15)",
    "tag_select": "SELECT qname, CASE WHEN length(f1) >= 3 THEN f1 ELSE r1 END AS tag FROM masked WHERE length(f1) >= 3 OR length(r1) >= 3",
    "tag_encode": "SELECT qname, tag, tag16, tag_key, list_sum(list_transform(range(0, 16), lambda i: substr(tag_key, (16 - i)::INT, 1)::BIGINT << (4 * i)::INT))::BIGINT AS packed, tag_key AS unpacked FROM rd",
    "base_code": "SELECT qname, greatest(instr('NATCGD', substr(seq, 1, 1)) - 1, 0)::BIGINT AS code, substr(seq, 1, 1) AS base FROM aln",
    "cigar_length": "SELECT qname, start, length, \"end\" FROM rd",
    "cigar_ops": "SELECT qname, idx, op, len, ref_off, query_off FROM ops JOIN rd USING (rid)",
    "pileup": "SELECT region, pos, base, count(*) AS n, sum(phred)::BIGINT AS phred_sum FROM obs GROUP BY ALL",
    "phred_mask": "SELECT region, CASE WHEN base <> 'D' AND phred < 30 THEN 'N' ELSE base END AS base, count(*) AS n FROM obs GROUP BY ALL",
    "read_insertions": "SELECT qname, region, pos, bases, array_to_string(phreds, ',') AS phreds FROM ins",
    "gap_islands": "SELECT qname, region, start, \"end\", block_id FROM blk",
    "block_having": "SELECT region, block_id, n_reads FROM blocks WHERE n_reads >= 45",
    "max_depth": "SELECT region, block_id, max_depth FROM blocks",
    "valid_blocks": "SELECT * FROM vb",
    "stats_blocks": "SELECT (SELECT count(*) FROM blocks) AS blocks, (SELECT sum(n_reads)::BIGINT FROM blocks) AS reads_in_blocks, count(*) AS valid_blocks, sum(n_reads)::BIGINT AS reads_in_valid_blocks, sum(length)::BIGINT AS valid_length FROM vb",
    "tag_groups": "SELECT region, block_id, tag_key, tag16, n_reads FROM tags",
    "cluster_none": "SELECT region, block_id, tag_key, tag_key AS allele_key, n_reads FROM tags",
    "tag_freq": "SELECT DISTINCT tag16, " + ", ".join(f"(length(tag16) - length(replace(tag16, '{b}', '')))::BIGINT AS n_{b.lower()}" for b in "NATCG") + " FROM tags",
    "lev_lower_bound": "SELECT region, block_id, key_a, key_b, bound FROM pairs",
    "tag_edges": "SELECT region, block_id, key_a, key_b, dist FROM near",
    "levenshtein": "SELECT region, block_id, key_a, key_b, levenshtein(tag_a, tag_b) AS dist, CASE WHEN levenshtein(tag_a, tag_b) <= 2 THEN levenshtein(tag_a, tag_b) ELSE -1 END AS dist2 FROM pairs",
    "tag_components": "SELECT region, block_id, tag_key, allele_key FROM clusters",
    "allele_tags": "SELECT region, block_id, allele_key, count(*) AS n_tags, sum(n_reads)::BIGINT AS n_reads FROM clusters GROUP BY ALL",
    "allele_having": "SELECT region, block_id, allele_key, n_reads, max_depth FROM alleles",
    "blocks_after": "SELECT DISTINCT region, block_id FROM alleles",
    "stats_cluster": "SELECT (SELECT count(*) FROM pairs) AS leven_total, (SELECT count(*) FROM pairs WHERE bound <= 2) AS leven_complete, (SELECT count(*) FROM tags) AS tags_before, (SELECT sum(n_reads)::BIGINT FROM tags) AS reads_before, count(*) AS alleles_after, sum(n_reads)::BIGINT AS reads_after, count(DISTINCT (region, block_id)) AS blocks_after FROM alleles",
    "hamming": "SELECT region, block_id, key_a, key_b, hamming(tag_a, tag_b) AS dist FROM pairs",
    "cluster_size_hist": "SELECT size, count(*) AS n FROM (SELECT region, block_id, allele_key, sum(n_reads)::BIGINT AS size FROM clusters GROUP BY ALL) GROUP BY size",
    "allele_ids": "SELECT region, block_id, allele_key, allele_id, start, \"end\" FROM alleles",
    "allele_coverage": "SELECT region, block_id, allele_id, pos, cov FROM votes",
    "ref_join": "SELECT region, block_id, allele_id, pos, ref_base FROM votes",
    "deviations": "SELECT region, block_id, allele_id, pos, cov, deviations FROM votes",
    "allele_variants": "SELECT region, block_id, allele_id, pos FROM av",
    "variant_positions": "SELECT region, block_id, pos FROM vp",
    "pos_x_allele": "SELECT region, block_id, allele_id, pos, cov FROM at_vp",
    "base_votes": "SELECT region, block_id, allele_id, pos, cov, mapq_sum, " + _FILL["NAMES"] + " FROM votes",
    "consensus": f"SELECT {_CONS} FROM cons WHERE NOT is_insertion",
    "insertion_support": "SELECT region, block_id, allele_id, pos, count(*) AS n_ins, max(cov) AS cov FROM sup GROUP BY ALL",
    "insertion_filter": "SELECT region, block_id, allele_id, pos, n_ins, cov FROM sites",
    "insertion_consensus": f"SELECT {_CONS} FROM cons WHERE is_insertion",
    "allele_hist": _HIST.format("at_pos"),
    "tmpvarcall": f"SELECT contig_idx, block_id, pos, is_insertion, pool_allele, {_LINE} AS line FROM vrows",
    "variant_rows": "SELECT * FROM vrows",
    "variant_allele_hist": _HIST.format("vrows WHERE NOT is_insertion"),
    "summary_stats": " UNION ALL ".join(f"SELECT '{n}' AS vector, {_SUMMARY}, {_MOMENTS} FROM ({d})" for n, d in (
        ("block_length", "SELECT length AS v FROM blocks"), ("tags_before", "SELECT count(*) AS v FROM tags GROUP BY region, block_id"),
        ("alleles_after", "SELECT count(*) AS v FROM alleles GROUP BY region, block_id"), ("positions_tested", "SELECT count(*) AS v FROM at_pos GROUP BY region, block_id"))),
    "stats_consensus": "SELECT * FROM counters",
    "stats_derived": _DERIVED,
    "pct": "SELECT region, " + _PCT.format("count(*) FILTER (tag_key = allele_key)", "count(*)") + " AS own_pct, '-' AS none_pct FROM clusters GROUP BY region",
    "region_blocks": "SELECT contig_idx, region, blocks, " + _PCT.format("blocks", "sum(blocks) OVER ()") + " AS pct FROM (SELECT contig_idx, contigs.region, count(b.block_id) AS blocks FROM contigs LEFT JOIN (SELECT DISTINCT region, block_id FROM alleles) b ON contigs.region = b.region GROUP BY ALL)",
    "top_tags": "SELECT tag16, n FROM (SELECT tag16, tag_key, sum(n_reads)::BIGINT AS n FROM tags GROUP BY ALL) ORDER BY n DESC, tag_key LIMIT 11",
    "dropout": _DROPOUT.format("all", "at_pos") + " UNION ALL " + _DROPOUT.format("variants", "(SELECT * FROM vrows WHERE NOT is_insertion)"),
}

#: Every counter of a run, each as a query of one number.
_COUNTERS = {
    "blocks": "SELECT count(*) FROM blocks", "reads_in_blocks": "SELECT sum(n_reads) FROM blocks", "valid_blocks": "SELECT count(*) FROM vb", "reads_in_valid_blocks": "SELECT sum(n_reads) FROM vb", "valid_length": "SELECT sum(length) FROM vb",
    "leven_total": "SELECT count(*) FROM pairs", "leven_complete": "SELECT count(*) FROM pairs WHERE bound <= 2", "tags_before": "SELECT count(*) FROM tags", "reads_before": "SELECT sum(n_reads) FROM tags",
    "alleles_after": "SELECT count(*) FROM alleles", "reads_after": "SELECT sum(n_reads) FROM alleles", "blocks_after": "SELECT count(DISTINCT (region, block_id)) FROM alleles",
    **{c: f"SELECT {c} FROM counters" for c in ("total", "conclusive", "ambiguous", "total_ins", "conclusive_ins", "ambiguous_ins", "total_del", "conclusive_del", "inconclusive_del")},
    "reference_bases": "SELECT sum(length) FROM vb WHERE (region, block_id) IN (SELECT (region, block_id) FROM alleles)", "positions_tested": "SELECT count(*) FROM at_pos", "positions_with_variants": "SELECT count(*) FROM vp", "reads_in_file": "SELECT count(*) FROM aln",
}
#: The order in which the fingerprint takes them; 0 for those that are never kept.
_PRINTED = ("0", "0", "valid_blocks", "reads_in_file", "0", "reads_in_valid_blocks", "0", "tags_before", "alleles_after", "reference_bases", "positions_tested", "positions_with_variants", "leven_complete", "leven_total", "total", "conclusive", "ambiguous", "blocks_after", "total_ins", "conclusive_ins", "ambiguous_ins", "total_del", "conclusive_del", "inconclusive_del")
_SELECTS["stats_run"] = " UNION ALL ".join(f"SELECT '{k}' AS counter, coalesce(({q}), 0)::BIGINT AS n" for k, q in sorted(_COUNTERS.items()))
_SELECTS["crc"] = f"""SELECT '0x' || printf('%08x', xor(list_reduce(zeros || bytes, lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1]), xor({0x12345678}, 4294967295)), 4294967295)) AS crc32 FROM (
SELECT list_transform(range(8000), lambda i: 0::BIGINT) AS zeros, flatten(list_transform([{", ".join(k if k == "0" else f"coalesce(({_COUNTERS[k]}), 0)::BIGINT" for k in _PRINTED)}], lambda v: list_transform(range(8), lambda i: (v >> (8 * i)::INT) & 255))) AS bytes,
list_transform(range(256), lambda n: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tbl)"""

ORACLE = {k: f"{_WITH} {v}" for k, v in _SELECTS.items()} | {
    "sessions": """WITH d AS (SELECT user_id, epoch(ts)::BIGINT AS t FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events)),
b AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS before FROM d),
g AS (SELECT *, (sum(CASE WHEN before IS NULL OR t >= before + 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING))::BIGINT AS block_id FROM b)
SELECT user_id, block_id, count(*) AS n, min(t) AS start, max(t) AS "end" FROM g GROUP BY user_id, block_id""",
    "price_summary": f"SELECT {_SUMMARY} FROM (SELECT floor(o_totalprice)::BIGINT AS v FROM orders)",
    "flag_majority": """SELECT l_partkey, CASE WHEN (a = m)::INT + (r = m)::INT + (n = m)::INT > 1 THEN 'N' WHEN a = m THEN 'A' WHEN r = m THEN 'R' ELSE 'N' END AS flag, (a = m)::INT + (r = m)::INT + (n = m)::INT > 1 AS is_ambiguous, m AS n
FROM (SELECT *, greatest(a, r, n) AS m FROM (SELECT l_partkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'N') AS n FROM lineitem GROUP BY l_partkey))""",
}
