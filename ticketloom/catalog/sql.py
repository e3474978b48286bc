"""Common table expressions for the SQL twins of the registered queries."""

from ticketloom import fixed_values as fv
from ticketloom.catalog.recipes import LOG_SQL, MESSAGES_SQL, quoted


def clean(text: str) -> str:
    no_urls = f"regexp_replace(coalesce({text}, ''), 'http\\S+|www\\S+', '', 'g')"
    no_mention = f"regexp_replace({no_urls}, '^@[A-Za-z0-9_]+\\s*', '')"
    return f"trim(regexp_replace(replace({no_mention}, '&amp;', '&'), '\\s+', ' ', 'g'))"


def handle(text: str) -> str:
    return f"nullif(regexp_extract({text}, '^\\s*@([A-Za-z0-9_]+)', 1), '')"


def count_of(text: str, char: str) -> str:
    return f"cast(length({text}) - length(replace({text}, '{char}', '')) as integer)"


def has_word(text: str, words) -> str:
    return f"regexp_matches({text}, '(?i)\\b(?:{'|'.join(words)})\\b')"


BRANDS = quoted(fv.BRANDS)

ROUTED = f"""{MESSAGES_SQL},
inbound_rows as (select *, {handle('text')} as airline from raw where inbound),
routed as (select * from inbound_rows where lower(airline) in ({BRANDS}))"""

CLEANED = f"""{ROUTED},
cleaned as (select * exclude (text), text as original_text, {clean('text')} as text from routed),
kept as (select * from cleaned
         where length(text) >= {fv.MIN_TICKET_CHARS}
           and lower(text) not in ({quoted(fv.BARE_PHRASES)})),
firsts as (select * exclude (nth) from (
  select *, row_number() over (partition by text order by tweet_id) as nth from kept)
  where nth = 1)"""

REPLIES = f"""replies as (
  select in_response_to_tweet_id as parent_id, tweet_id as reply_id, {clean('text')} as reply
  from raw where inbound is distinct from true and in_response_to_tweet_id is not null
    and length({clean('text')}) >= {fv.MIN_REPLY_CHARS}),
joined as (select parent_id, string_agg(reply, '{fv.REPLY_SEPARATOR}' order by reply_id) as response,
                  count(*) as replies
           from replies group by parent_id)"""

TICKETS = f"""{CLEANED},
{REPLIES},
tickets as (select f.tweet_id, f.author_id as customer_id, f.airline, f.created_at, f.inbound,
                   f.original_text, f.text, coalesce(j.response, '') as agent_response
            from firsts f left join joined j on j.parent_id = f.tweet_id)"""


def signals(text: str) -> str:
    letters = f"length(regexp_replace({text}, '\\P{{L}}', '', 'g'))"
    capitals = f"length(regexp_replace({text}, '\\P{{Lu}}', '', 'g'))"
    return f"""
      {has_word(text, fv.CRITICAL_WORDS)} as has_critical_signal,
      {has_word(text, fv.URGENCY_WORDS)} as has_urgency_keywords,
      {has_word(text, fv.DELAY_PHRASES)} as has_delay,
      {has_word(text, fv.PROFANITY_WORDS)} as has_profanity,
      {has_word(text, fv.SARCASM_PHRASES)} as has_sarcasm,
      {count_of(text, '!')} as exclamation_count,
      {count_of(text, '?')} as question_count,
      case when {letters} > 0 then {capitals}::double / {letters} else 0.0::double end
        as caps_ratio"""


SCORE = f"""case when has_critical_signal then {fv.CRITICAL_SCORE} else
  {fv.DELAY_POINTS} * has_delay::int + {fv.URGENCY_POINTS} * has_urgency_keywords::int
  + has_profanity::int + (caps_ratio > {fv.CAPS_LIMIT})::int
  + (exclamation_count >= {fv.EXCLAMATION_LIMIT})::int end"""


def labeled_from(source: str) -> str:
    """CTEs signals / labeled over a relation with a text column."""
    return f"""
raised as (select *, {signals('text')} from {source}),
scored as (select *, cast({SCORE} as integer) as score from raised),
labeled as (select *, case when score >= {fv.URGENT_FROM} then 'URGENT' else 'NORMAL' end
              as priority from scored)"""


LABELED = f"{TICKETS},{labeled_from('tickets')}"
# labels without the reply join
LABELED_ONLY = f"{CLEANED},{labeled_from('firsts')}"


def features(text: str) -> str:
    low = f"lower({text})"
    capitals = f"length(regexp_replace({text}, '\\P{{Lu}}', '', 'g'))"
    profane = "|".join(fv.FEATURE_PROFANITY)
    flags = ",\n".join(
        f"cast(regexp_matches({low}, '{pattern}') as integer) as {name}"
        for name, pattern in fv.FEATURE_PATTERNS.items()
    )
    return f"""
      cast(length({text}) as integer) as text_length,
      cast(len(regexp_extract_all({text}, '\\S+')) as integer) as word_count,
      {count_of(text, '!')} as exclamation_count,
      {count_of(text, '?')} as question_count,
      {capitals}::double / greatest(length({text}), 1) as caps_ratio,
      cast(len(regexp_extract_all({low}, '\\b(?:{profane})\\b')) as integer) as profanity_count,
      {flags}"""


FEATURED = f"""{LABELED_ONLY},
featured as (select tweet_id, airline, created_at,
  cast(priority = 'URGENT' as integer) as is_urgent, priority, score,
  has_urgency_keywords, has_critical_signal, has_profanity, has_sarcasm,
  {features('text')} from labeled)"""

CALLS = LOG_SQL
PARSED = f"""{CALLS},
log as (select *, case when contains(upper(completion), 'URGENT') then 'URGENT' else 'NORMAL' end
          as llm_label from calls),
prices as (select * from (values {', '.join(
    f"('{name}', {i}::double, {o}::double)" for name, (i, o) in fv.PRICES.items())})
  as t(provider, usd_in, usd_out)),
costed as (select l.*, coalesce(round((l.input_tokens * p.usd_in + l.output_tokens * p.usd_out)
             / 1000000, 6), 0.0::double) as cost_usd
           from log l left join prices p using (provider))"""


def percentile(value: str, p: float) -> str:
    return f"quantile_cont({value}::double, {p})"
