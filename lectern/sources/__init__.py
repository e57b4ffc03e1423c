"""Readers and writers: course JSON folders, crawl registries, documents, exports and the versioned store."""
