"""Reading and writing: tables, files, JDBC, Kafka, layouts."""
