"""DataFrame operators: pages, sections, dedup, reports, geography, TF-IDF, clusters."""
