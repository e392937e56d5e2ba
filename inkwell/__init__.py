"""inkwell: document, conversation and account analytics as Spark plans."""
