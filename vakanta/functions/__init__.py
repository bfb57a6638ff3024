"""Column functions: text, dates, places, titles, levels, skills."""
