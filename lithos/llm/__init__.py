"""Training-data operators: ten DataFrame operators for corpora of documents, pages, vectors and chats."""
