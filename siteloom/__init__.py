"""siteloom: crawl analytics and site audits as Spark jobs over many crawls."""
