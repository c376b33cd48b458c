"""ripplework: live views over keyed, changing collections, expressed as Spark plans."""
