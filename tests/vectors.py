"""Descriptors in hexadecimal with what they say, worked out by hand from the standards: fixed values that views are held against.

(family, tag, whole descriptor, fields as JSON without nulls; of a loop, a line for each item).
"""

VECTORS = [
    ("dvb", 0x13, "1305000000070055", '{"carousel_id":7,"format_id":0,"private_data":""}'),
    ("dvb", 0x13, "1317000000090102000301000000040005000000060702AABB", '{"carousel_id":9,"format_id":1,"module_version":2,"module_id":3,"block_size":256,"module_size":1024,"compression_method":5,"original_size":6,"time_out":7,"object_key":"qrs=","private_data":""}'),
    ("dvb", 0x14, "140F1234000008000000050000000AEE01", '{"association_tag":4660,"use":0,"selector_length":8,"transaction_id":5,"time_out":10,"private_data":"7gE="}'),
    ("dvb", 0x14, "1407001100020201FF", '{"association_tag":17,"use":2,"selector_length":2,"selector":"Af8=","private_data":""}'),
    ("dvb", 0x2A, "2A0F810000000003000000050000000AA0", '{"hrd_management_valid":true,"picture_and_timing":true,"flag_90khz":false,"n":3,"k":5,"num_units_in_tick":10,"fixed_frame_rate":true,"temporal_poc":false,"picture_to_display_conversion":true}'),
    ("dvb", 0x2A, "2A020040", '{"hrd_management_valid":false,"picture_and_timing":false,"fixed_frame_rate":false,"temporal_poc":true,"picture_to_display_conversion":false}'),
    ("dvb", 0x45, "4507010327080503012A", '{"item":0,"data_service_id":1,"data_service":"EBU teletext","lines":[{"field_parity":true,"line_offset":7},{"field_parity":false,"line_offset":8},{"field_parity":false,"line_offset":5}]}'),
    ("dvb", 0x64, "640C012305020102656E67026869", '{"data_broadcast_id":291,"component_tag":5,"selector":"AQI=","language":"eng","text":"hi"}'),
    ("dvb", 0x6C, "6C120007FFFE0003123456080900010002ABCDEF", '{"item":0,"cell_id":7,"latitude":-2,"longitude":3,"extent_latitude":291,"extent_longitude":1110,"subcells":[{"extension":9,"latitude":1,"longitude":2,"extent_latitude":2748,"extent_longitude":3567}]}'),
    ("dvb", 0x6D, "6D0C00070000010005090000000A", '{"item":0,"cell_id":7,"frequency":2560,"subcells":[{"extension":9,"frequency":100}]}'),
    ("dvb", 0x7C, "7C0451C003AA", '{"profile_and_level":81,"aac_type_present":true,"saoc_de":true,"aac_type":3,"additional_info":"qg=="}'),
    ("dvb", 0x7C, "7C03514099", '{"profile_and_level":81,"aac_type_present":false,"saoc_de":true,"additional_info":"mQ=="}'),
    ("dvb", 0x7C, "7C0151", '{"profile_and_level":81,"additional_info":""}'),
    ("dvb", 0x87, "870C01025456525553040064850A", '{"item":0,"list_id":1,"list_name":"TV","country":"RUS","services":[{"service_id":100,"visible":true,"for_stb":false,"for_cam":false,"for_tv":false,"flag_4":false,"flag_5":true,"lcn":266}]}'),
    ("dvb", 0x88, "880A7275730602546502446F", '{"item":0,"language":"rus","list_name":"Te","translation":"Do"}'),
    ("dvb", 0x89, "8915034F7265", '{"region_name":"Ore"}'),
    ("dvb", 0x90, "9015025A31", '{"zone_name":"Z1"}'),
    ("dvb", 0xB0, "B00802312E8200000E10", '{"service_version":"1.","service_status":true,"update_type":2,"update":"forced update in normal mode","last_update_sec":3600}'),
    ("dvb", 0xB1, "B110013203000100020003000000780211647E", '{"service_version":"2","service_status":false,"update_type":3,"update":"voluntary update in normal mode","service_id":1,"original_network_id":2,"ts_id":3,"last_update_sec":120,"receiver_ids":[17,100]}'),
    ("dvb", 0xB2, "B2050161020102", '{"item":0,"postfix":"a","receiver_ids":[1,2]}'),
    ("dvb", 0xB4, "B406014C00030102", '{"list_name":"L","zones":[3,258]}'),
    ("dvb", 0xC0, "C005015302016E", '{"service_name":"S","receiver_ids":[1,110]}'),
    ("dvb", 0x48, "480801025456034E4557", '{"service_type":1,"provider":"TV","service_name":"NEW"}'),
    ("dvb", 0x4D, "4D08656E670268690121", '{"language":"eng","event_name":"hi","text":"!"}'),
    ("dvb", 0x4E, "4E0D12656E670602484902796F017A", '{"number":1,"last_number":2,"language":"eng","items":[{"description":"SEk=","item":"eW8="}],"text":"z"}'),
    ("dvb", 0x5C, "5C06656E67024142", '{"item":0,"language":"eng","text":"AB"}'),
    ("dvb", 0x6A, "6A04A0010209", '{"component_type":1,"main_id":2,"additional_info":"CQ=="}'),
    ("ext", 0x00, "7F0600120702AABB", '{"descriptor_number":1,"last_descriptor_number":2,"icon_id":7,"icon_data":"qrs="}'),
    ("ext", 0x00, "7F0D0002032812345603706E670155", '{"descriptor_number":0,"last_descriptor_number":2,"icon_id":3,"transport_mode":0,"positioned":true,"coordinate_system":2,"horizontal_origin":291,"vertical_origin":1110,"icon_type":"png","icon_data":"VQ=="}'),
    ("ext", 0x04, "7F1204050102444400070000000A05090000000B", '{"plp_id":5,"t2_system_id":258,"siso_miso":1,"bandwidth":1,"guard_interval":2,"transmission_mode":1,"other_frequency":false,"tfs":false,"cells":[{"cell_id":7,"frequencies":[10],"subcells":[{"extension":9,"frequency":11}]}]}'),
    ("ext", 0x04, "7F0404050102", '{"plp_id":5,"t2_system_id":258,"cells":[]}'),
    ("ait", 0x00, "000A0500030102039F05090A", '{"profiles":[{"profile":3,"major":1,"minor":2,"micro":3}],"service_bound":true,"visibility":0,"priority":5,"protocol_labels":[9,10]}'),
    ("ait", 0x01, "0107656E6703617070", '{"item":0,"language":"eng","application_name":"app"}'),
    ("ait", 0x03, "0303026162", '{"item":0,"parameter":"YWI="}'),
    ("ait", 0x04, "0407022F61017A4D61", '{"base_directory":"/a","classpath_extension":"z","initial_class":"Ma"}'),
    ("splice", 0x02, "021743554549000000057FFF00000DBBA00903414243340102", '{"identifier":1129661769,"event_id":5,"cancelled":false,"program":true,"has_duration":true,"not_restricted":true,"duration":900000,"upid_type":9,"upid":"QUJD","type_id":52,"segment":1,"segments":2}'),
    ("splice", 0x04, "040A435545491F03656E6753", '{"identifier":1129661769,"audio_count":1,"channels":[{"component_tag":3,"language":"eng","bit_stream_mode":2,"n_channels":9,"full_service":true}]}'),
    ("dvb", 0x02, "02039A485F", '{"multiple_frame_rate":true,"frame_rate_code":3,"mpeg1_only":false,"constrained":true,"still_picture":false,"profile_and_level":72,"chroma_format":1,"frame_rate_extension":false}'),
    ("dvb", 0x02, "02010C", '{"multiple_frame_rate":false,"frame_rate_code":1,"mpeg1_only":true,"constrained":false,"still_picture":false}'),
    ("dvb", 0x03, "0301E7", '{"free_format":true,"id":true,"layer":2,"variable_rate":false}'),
    ("dvb", 0x05, "050643554549AABB", '{"format_identifier":1129661769,"additional_info":"qrs="}'),
    ("dvb", 0x06, "060103", '{"alignment_type":3}'),
    ("dvb", 0x09, "09060B00E1F4CAFE", '{"ca_system_id":2816,"ca_pid":500,"private_data":"yv4="}'),
    ("dvb", 0x09, "09064AE0E1F40210", '{"ca_system_id":19168,"ca_pid":500,"private_data":"AhA=","provider_id":2,"service_id":16,"provider":"CAS 3.0","service":"Info cas new"}'),
    ("splice", 0x02, "021143554549000000067FBF09003601020304", '{"identifier":1129661769,"event_id":6,"cancelled":false,"program":true,"has_duration":false,"not_restricted":true,"upid_type":9,"upid":"","type_id":54,"segment":1,"segments":2,"sub_segment":3,"sub_segments":4}'),
    ("splice", 0x05, "0506435545490102", '{"identifier":1129661769,"private_bytes":"AQI="}'),
    ("dvb", 0x0A, "0A08656E670372757300", '{"item":0,"language":"eng","audio_type":3}\n{"item":1,"language":"rus","audio_type":0}'),
    ("dvb", 0x0C, "0C0481238456", '{"bound_valid":true,"ltw_lower_bound":291,"ltw_upper_bound":1110}'),
    ("dvb", 0x0E, "0E03C186A0", '{"maximum_bitrate":100000}'),
    ("dvb", 0x0F, "0F0400000028", '{"private_data_indicator":40}'),
    ("dvb", 0x11, "1101FF", '{"leak_valid":true}'),
    ("dvb", 0x28, "28046440293F", '{"profile_idc":100,"constraint_set0":false,"constraint_set1":true,"constraint_set2":false,"constraint_set3":false,"constraint_set4":false,"constraint_set5":false,"avc_compatible":0,"level_idc":41,"still_present":false,"picture_24_hour":false,"frame_packing_not_present":true}'),
    ("dvb", 0x38, "380D01600000009000000000007B5E", '{"profile_space":0,"tier":false,"profile_idc":1,"profile_compatibility":1610612736,"progressive":true,"interlaced":false,"non_packed":false,"frame_only":true,"copied_44_bits":0,"level_idc":123,"temporal_layer_subset":false,"still_present":true,"picture_24_hour":false,"sub_pic_not_present":true,"hdr_wcg_idc":2}'),
    ("dvb", 0x38, "380F01600000009000000000007BDE3FDF", '{"profile_space":0,"tier":false,"profile_idc":1,"profile_compatibility":1610612736,"progressive":true,"interlaced":false,"non_packed":false,"frame_only":true,"copied_44_bits":0,"level_idc":123,"temporal_layer_subset":true,"still_present":true,"picture_24_hour":false,"sub_pic_not_present":true,"hdr_wcg_idc":2,"temporal_id_min":1,"temporal_id_max":6}'),
    ("dvb", 0x40, "40034E6574", '{"network_name":"Net"}'),
    ("dvb", 0x41, "4106006401006502", '{"item":0,"service_id":100,"service_type":1}\n{"item":1,"service_id":101,"service_type":2}'),
    ("dvb", 0x43, "430B011725000192CE02750003", '{"frequency":1172500,"orbital_position":192,"west_east":true,"polarization":2,"roll_off":1,"modulation_system":true,"modulation_type":2,"symbol_rate":275000,"fec_inner":3}'),
    ("dvb", 0x44, "440B03460000FFF2030068750F", '{"frequency":3460000,"fec_outer":2,"modulation":3,"symbol_rate":68750,"fec_inner":15}'),
    ("dvb", 0x47, "47025456", '{"bouquet_name":"TV"}'),
    ("dvb", 0x4A, "4A09000A000B000C04AABB", '{"ts_id":10,"original_network_id":11,"service_id":12,"linkage_type":4,"private_data":"qrs="}'),
    ("dvb", 0x50, "5008F50B01656E674844", '{"stream_content_ext":15,"stream_content":5,"component_type":11,"component_tag":1,"language":"eng","text":"HD"}'),
    ("dvb", 0x52, "52012A", '{"component_tag":42}'),
    ("dvb", 0x53, "530405000B00", '{"item":0,"ca_system_id":1280}\n{"item":1,"ca_system_id":2816}'),
    ("dvb", 0x54, "540441FF2007", '{"item":0,"nibble1":4,"nibble2":1,"user_byte":255}\n{"item":1,"nibble1":2,"nibble2":0,"user_byte":7}'),
    ("dvb", 0x55, "55045255530F", '{"item":0,"country":"RUS","rating":15}'),
    ("dvb", 0x56, "5605656E671188", '{"item":0,"language":"eng","teletext_type":2,"magazine":1,"page":136}'),
    ("dvb", 0x58, "580D5255530603009E8B0102030400", '{"item":0,"country":"RUS","region_id":1,"negative":false,"offset_min":180,"change_sec":3723,"next_offset_min":240}'),
    ("dvb", 0x59, "5908656E671000010002", '{"item":0,"language":"eng","subtitling_type":16,"composition_page":1,"ancillary_page":2}'),
    ("dvb", 0x5A, "5A0B02FAF0801F821AFFFFFFFF", '{"centre_frequency":500000000,"bandwidth":0,"priority":true,"time_slicing":true,"mpe_fec":true,"constellation":2,"hierarchy":0,"code_rate_hp":2,"code_rate_lp":0,"guard_interval":3,"transmission_mode":1,"other_frequency":false}'),
    ("dvb", 0x5F, "5F0400000028", '{"private_data_specifier":40}'),
    ("dvb", 0x60, "6006000100020003", '{"new_original_network_id":1,"new_ts_id":2,"new_service_id":3}'),
    ("dvb", 0x66, "66040123AABB", '{"data_broadcast_id":291,"selector":"qrs="}'),
    ("dvb", 0x6F, "6F038010E3", '{"item":0,"application_type":16,"ait_version":3}'),
    ("dvb", 0x70, "700105", '{"adaptation_field_data_id":5}'),
    ("dvb", 0x83, "83080064FC0500657C06", '{"item":0,"service_id":100,"visible":true,"lcn":5}\n{"item":1,"service_id":101,"visible":false,"lcn":6}'),
    ("dvb", 0x86, "8606000100020003", '{"item":0,"ts_id":1,"original_network_id":2,"service_id":3}'),
    ("dvb", 0x8A, "8A0101", '{"cue_stream_type":1}'),
    ("ait", 0x02, "0205000105AABB", '{"protocol_id":1,"protocol_label":5,"selector":"qrs="}'),
    ("ait", 0x10, "100701A00000000709", '{"storage_property":1,"not_from_broadcast":true,"complete_from_cache":false,"with_older_version":true,"version":7,"priority":9}'),
    ("ait", 0x15, "15042F696E78", '{"initial_path":"/inx"}'),
    ("splice", 0x00, "00084355454900000007", '{"identifier":1129661769,"provider_avail_id":7}'),
    ("splice", 0x01, "010843554549325F3132", '{"identifier":1129661769,"preroll":50,"dtmf_count":2,"dtmf_chars":"12"}'),
    ("splice", 0x03, "031043554549000000000064000000070025", '{"identifier":1129661769,"tai_seconds":100,"tai_ns":7,"utc_offset":37}'),
]
