"""corvid: document analytics and lexical retrieval as Spark DataFrame plans."""
