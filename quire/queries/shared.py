"""SQL fragments shared by the queries' comparison statements."""

WS = r" \t\n\f\r\x0B"

# lines(doc_id, lang, source, line_no, line, n_lines) of documents
LINES = r"""
parts AS (
  SELECT doc_id, lang, source, string_split_regex(text, '\r?\n') AS p FROM documents),
cut AS (
  SELECT doc_id, lang, source, CASE WHEN p[len(p)] = '' THEN p[1:len(p)-1] ELSE p END AS p
  FROM parts),
lines AS (
  SELECT doc_id, lang, source, len(p) AS n_lines, unnest(p) AS line,
         unnest(range(len(p))) AS line_no FROM cut)
"""


def words_of(lines: str, name: str = "words", keys: str = "doc_id, line_no") -> str:
    """CTEs turning rows with (keys, line) into words with idx, word, start_at."""
    return f"""
{name}_segments AS (
  SELECT {keys}, unnest(s) AS seg, unnest(range(len(s))) AS idx
  FROM (SELECT {keys}, regexp_extract_all(line, '[{WS}]*[^{WS}]+') AS s FROM {lines})),
{name} AS (
  SELECT {keys}, idx, ltrim(seg, chr(32)||chr(9)||chr(10)||chr(12)||chr(13)||chr(11)) AS word,
         sum(length(seg)) OVER (PARTITION BY {keys} ORDER BY idx)
         - length(ltrim(seg, chr(32)||chr(9)||chr(10)||chr(12)||chr(13)||chr(11))) AS start_at
  FROM {name}_segments)
"""


def luhn_ok(d: str) -> str:
    return f"""(regexp_matches({d}, '^[0-9]{{13,19}}$') AND list_sum(list_transform(range(1, 20),
      lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(lpad({d}, 19, '0'), i, 1) AS INT)
        ELSE CAST(substr('0246813579', CAST(substr(lpad({d}, 19, '0'), i, 1) AS INT) + 1, 1) AS INT)
        END)) % 10 = 0)"""


def iban_ok(t: str) -> str:
    body = f"regexp_replace({t}, '[^A-Za-z0-9]', '', 'g')"
    return f"""(regexp_matches({body}, '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}$') AND
      list_reduce(list_transform(string_split(substr({body}, 5) || substr({body}, 1, 4), ''),
        lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END),
        lambda a, v: (a * (CASE WHEN v > 9 THEN 100 ELSE 10 END) + v) % 97, 0) = 1)"""


def nir_ok(d: str) -> str:
    return f"""(CASE WHEN regexp_matches({d}, '^[12][0-9]{{14}}$')
      THEN CAST(substr({d}, 14, 2) AS INT) = 97 - CAST(substr({d}, 1, 13) AS BIGINT) % 97
      ELSE regexp_matches({d}, '^[12][0-9]{{12}}$') END)"""


def phone_ok(t: str) -> str:
    bare = f"regexp_replace({t}, '[ .()-]', '', 'g')"
    return (f"(regexp_matches({bare}, '^[+][0-9]{{9,14}}$') "
            f"OR regexp_matches({bare}, '^0[1-79][0-9]{{8}}$'))")


def email_ok(t: str) -> str:
    return f"regexp_matches({t}, '^[^@]+@[^@]*[.][A-Za-z]{{2,}}$')"


def digits(t: str) -> str:
    return f"regexp_replace({t}, '[^0-9]', '', 'g')"


def mask_email(t: str) -> str:
    user = f"split_part({t}, '@', 1)"
    return (f"(CASE WHEN length({user}) <= 2 THEN '**' ELSE left({user}, 1) || '***' || "
            f"right({user}, 1) END || '@' || split_part({t}, '@', 2))")


def mask_digits(d: str) -> str:
    return f"('•••• •••• •••• ' || right({d}, 4))"


def mask_iban(t: str) -> str:
    return f"(left({t}, 4) || ' •••• •••• ' || right({t}, 4))"


def mask_phone(t: str) -> str:
    return f"('+•• • •• •• ' || right({t}, 4))"
