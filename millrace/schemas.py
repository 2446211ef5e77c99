"""Schemas of the tables that the library reads and makes."""

MENTION = "struct<source_id:string,source_name:string,url:string>"
ARTICLE = f"seq long, title string, url string, source_id string, source_name string, title_raw string, published_at timestamp, published_raw string, summary string, summary_raw string, topic string, tags array<string>, mentions array<{MENTION}>, score double, flags array<string>"
SOURCE = "id string, name string, homepage string, feeds array<string>, lang string, topics array<string>, weight int, flags array<string>"
FETCH = "source_id string, url string, success boolean, content string, status_code int, error string, fetched_at timestamp"
METRICS = "struct<like_count:long,retweet_count:long,reply_count:long,quote_count:long,bookmark_count:long,impression_count:long>"
POST = f"id string, text string, full_text string, created_at string, author_id string, in_reply_to_user_id string, conversation_id string, public_metrics {METRICS}, note_tweet struct<text:string>, referenced_tweets array<struct<type:string,id:string>>, entities struct<hashtags:array<struct<tag:string>>,urls:array<struct<url:string,expanded_url:string>>>, attachments struct<media_keys:array<string>>, tweet_type string"
USER_POSTS = f"date string, results array<struct<user_id:string,username:string,name:string,followers_count:long,latest_tweet_id:string,tweets:array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in POST.split(', '))}>>>>"
COLUMN = "struct<name:string,type:string,comment:string>"
SIGNALS = "struct<source_tables:array<string>,group_by:array<string>,row_number_keys:array<string>,has_distinct:boolean,has_row_number:boolean>"
QA = "id string, ts string, skill string, label string, question string, answer string, feedback struct<text:string,issues:array<string>>, issues array<string>, dialect string, warehouse_path string, sql_path string, meta map<string,string>"
