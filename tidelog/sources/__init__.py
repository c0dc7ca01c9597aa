"""Tables on storage: manifests, log and base files, mirrors, replicas and exports."""
