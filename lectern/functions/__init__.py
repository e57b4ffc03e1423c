"""Column functions: text, course codes, credits, schedules, prerequisites, suitability, URLs and HTML."""
