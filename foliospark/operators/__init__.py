"""DataFrame operators over pages, blocks, lines, spans and cells; keys are doc_id and page_id."""
