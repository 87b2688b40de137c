"""PySpark-native analytics over crawled news: cleaning, URL rules, dedup, scoring, matching, state."""
